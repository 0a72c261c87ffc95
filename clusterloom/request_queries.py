"""Queries over requests: settings, guards, errors, prompts and replies, providers, budgets in streams and in one process."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.engine import Engine
from clusterloom.errors import BlockedAddress, TooManyRequests, status_of
from clusterloom.functions.text import token_set
from clusterloom.operators.clustering import cluster_phrases, embedding_threshold, method_of, requested_phrases
from clusterloom.operators.providers import CallableWriter, TableEmbedder, clustering_prompt, embedded, merging_prompt, parsed_clusters, parsed_page
from clusterloom.operators.similarity import cosine, similar_pairs
from clusterloom.plans.runtime import checkpoint_dir
from clusterloom.queries import DAY, _limit_sql, _tokens_sql, query, table
from clusterloom.sources.fetching import concurrency, guarded, read_capped, safe_fetch
from clusterloom.streaming.progress import Progress
from clusterloom.streaming.rate_limit import Budget, Limiter, rate_limit_stream


def _cases(*rows: tuple[str, str]) -> str:
    """SQL of expected (request, answer) rows."""
    return "SELECT * FROM (VALUES " + ", ".join("('" + a.replace("'", "''") + "', '" + b.replace("'", "''") + "')" for a, b in rows) + ") t(request, answer)"


def _answers(spark: SparkSession, asked: dict[str, Callable[[], object]]) -> DataFrame:
    """(request, answer): what each call gives, or the kind of its error and the status a service would send."""
    rows = []
    for name, call in asked.items():
        try:
            rows.append((name, str(call())))
        except Exception as e:  # noqa: BLE001
            rows.append((name, f"{type(e).__name__} {status_of(e)}"))
    return spark.createDataFrame(rows, "request string, answer string")


@query(_cases(("lexical", "lexical"), ("semantic", "semantic"), ("nonsense", "lexical"), ("none", "lexical"), ("strict nonsense", "InvalidInput 400"), ("threshold 0.3", "0.3"), ("threshold 0", "0.55"), ("threshold x", "0.55"), ("threshold nan", "0.55"), ("threshold -1", "-1.0"),
              ("at once unset", "8"), ("at once 3.9", "3"), ("at once 99", "16"), ("at once -1", "8")))
def settings(spark, sf):
    """Methods, thresholds and concurrency from what a request or the environment says."""
    return _answers(spark, {
        "lexical": lambda: method_of("lexical"), "semantic": lambda: method_of("semantic"), "nonsense": lambda: method_of("nonsense"), "none": lambda: method_of(None), "strict nonsense": lambda: method_of("nonsense", True), "threshold 0.3": lambda: embedding_threshold("0.3"),
        "threshold 0": lambda: embedding_threshold("0"), "threshold x": lambda: embedding_threshold("x"), "threshold nan": lambda: embedding_threshold("nan"), "threshold -1": lambda: embedding_threshold("-1"),
        "at once unset": lambda: concurrency(""), "at once 3.9": lambda: concurrency("3.9"), "at once 99": lambda: concurrency("99"), "at once -1": lambda: concurrency("-1"),
    })


def _phrases(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("w"), "id").alias("phrase"))


@query(_cases(("no phrase", "InvalidInput 400"), ("501 phrases", "InvalidInput 400"), ("500 phrases", "500"), ("one merge source", "InvalidInput 400"), ("seven merge sources", "InvalidInput 400"), ("no page", "InvalidInput 400"), ("embeddings without provider", "Unavailable 400"),
              ("semantic without provider", "Unavailable 400"), ("blocked", "BlockedAddress 400"), ("budget", "TooManyRequests 429"), ("bug", "KeyError 500"), ("capabilities", "{'embeddings': False, 'semantic': False, 'merging': False, 'ai_available': False}"), ("capabilities with writer", "{'embeddings': False, 'semantic': True, 'merging': True, 'ai_available': True}")))
def request_errors(spark, sf):
    """Requests that can't be served, as a service answers them; and what it says it can do."""
    engine = Engine()
    none = spark.createDataFrame([], "url string, ok boolean, status int, final_url string, html string")
    urls = lambda n: spark.createDataFrame([(i, f"u{i}") for i in range(n)], "ord long, url string")

    def fail(e: Exception):
        raise e

    return _answers(spark, {
        "no phrase": lambda: engine.cluster_phrases(_phrases(spark, 0)), "501 phrases": lambda: engine.cluster_phrases(_phrases(spark, 501)), "500 phrases": lambda: engine.cluster_phrases(_phrases(spark, 500)).clusters.count(), "one merge source": lambda: engine.merge_similar(urls(1), none),
        "seven merge sources": lambda: engine.merge_similar(urls(7), none), "no page": lambda: engine.cluster_site(none), "embeddings without provider": lambda: engine.cluster_phrases(_phrases(spark, 2), "embeddings"), "semantic without provider": lambda: engine.cluster_phrases(_phrases(spark, 2), "semantic"),
        "blocked": lambda: fail(BlockedAddress("x")), "budget": lambda: fail(TooManyRequests(3)), "bug": lambda: {}["x"], "capabilities": engine.capabilities, "capabilities with writer": Engine(writer=CallableWriter(lambda s, u: "{}")).capabilities,
    })


@query(_cases(("public", "['8.8.8.8']"), ("one private", "BlockedAddress 400"), ("no answer", "BlockedAddress 400"), ("localhost", "BlockedAddress 400"), ("sub.localhost", "BlockedAddress 400"), ("ftp", "BlockedAddress 400"), ("capped", "b'abcd'"), ("under the cap", "b'abcdef'"),
              ("redirect", "(True, 200, 'http://b.com/y', 'text')"), ("redirect into a private network", "BlockedAddress 400"), ("too many redirects", "BlockedAddress 400"), ("redirect to nowhere", "(False, 302, 'http://e.com/', '')"), ("not found", "(False, 404, 'http://d.com/', 'none')")))
def guarded_fetches(spark, sf):
    """What a guarded fetch does with addresses, redirects and large bodies; names and answers are made up."""
    names = {"a.com": ["8.8.8.8"], "b.com": ["8.8.4.4"], "c.com": ["8.8.8.8", "10.0.0.1"], "d.com": ["8.8.8.8"], "e.com": ["8.8.8.8"], "f.com": ["8.8.8.8"], "none.com": []}
    web = {"http://a.com/": (301, {"location": "//b.com/y"}), "http://b.com/y": (200, {}), "http://f.com/": (302, {"location": "http://c.com/"}), "http://e.com/": (302, {}), "http://d.com/": (404, {})}

    def get(url, address, seconds):
        status, headers = web.get(url, (302, {"location": url + "x"}))
        return status, headers, iter([b"text" if status == 200 else b"none"])

    def fetch(url):
        return safe_fetch(url, look_up=names.__getitem__, get=get)

    return _answers(spark, {
        "public": lambda: guarded("http://a.com/", names.__getitem__), "one private": lambda: guarded("http://c.com/", names.__getitem__), "no answer": lambda: guarded("http://none.com/", names.__getitem__), "localhost": lambda: guarded("http://localhost/", names.__getitem__),
        "sub.localhost": lambda: guarded("http://sub.localhost/", names.__getitem__), "ftp": lambda: guarded("ftp://a.com/", names.__getitem__), "capped": lambda: read_capped([b"ab", b"cd", b"ef"], 5), "under the cap": lambda: read_capped([b"ab", b"cd", b"ef"], 6),
        "redirect": lambda: fetch("http://a.com/"), "redirect into a private network": lambda: fetch("http://f.com/"), "too many redirects": lambda: fetch("http://b.com/loop"), "redirect to nowhere": lambda: fetch("http://e.com/"), "not found": lambda: fetch("http://d.com/"),
    })


@query(_cases(("good clusters", "[{'name': 'A', 'mainPhrase': 'a', 'phrases': ['a']}]"), ("no clusters", "ValueError 500"), ("a cluster without phrases", "ValueError 500"), ("no JSON", "ValueError 500"), ("empty", "ValueError 500"), ("good page", "{'title': 't', 'metaDescription': 'm', 'content': 'c'}"), ("page without title", "ValueError 500"),
              ("list in prompt", "True"), ("context in prompt", "True"), ("no context in prompt", "True"), ("sources in prompt", "True")))
def model_replies(spark, sf):
    """Prompts hold what they must, and replies are taken only in their format."""
    return _answers(spark, {
        "good clusters": lambda: parsed_clusters('{"clusters":[{"name":"A","mainPhrase":"a","phrases":["a"]}]}'), "no clusters": lambda: parsed_clusters('{"clusters":[]}'), "a cluster without phrases": lambda: parsed_clusters('{"clusters":[{"name":"A","mainPhrase":"a","phrases":[]}]}'),
        "no JSON": lambda: parsed_clusters("sure!"), "empty": lambda: parsed_clusters(""), "good page": lambda: parsed_page('{"title":"t","metaDescription":"m","content":"c","more":1}'), "page without title": lambda: parsed_page('{"metaDescription":"m","content":"c"}'),
        "list in prompt": lambda: clustering_prompt(["x", "y"], None, False)[1].endswith("1. x\n2. y"), "context in prompt": lambda: '"roofs"' in clustering_prompt(["x"], " roofs ", True)[1], "no context in prompt": lambda: "No context" in clustering_prompt(["x"], " ", True)[1],
        "sources in prompt": lambda: "SOURCE 2: L2 (u2) ---\nc2" in merging_prompt([("L1", "u1", "c1"), ("L2", "u2", "c2")], None)[1],
    })


@query("WITH s AS (SELECT source AS phrase, min(doc_id) AS o FROM documents GROUP BY source), n AS (SELECT *, row_number() OVER (ORDER BY o) AS r FROM s) SELECT 1::BIGINT AS rank, 'First' AS name, (SELECT phrase FROM n WHERE r = 1) AS main_phrase, string_agg(phrase, '|' ORDER BY r) AS phrases FROM n WHERE r <= 2 UNION ALL SELECT 2, 'Inne', (SELECT phrase FROM n WHERE r = 3), string_agg(phrase, '|' ORDER BY r) FROM n WHERE r > 2 HAVING count(*) > 0")
def semantic_answer(spark, sf):
    """Clusters of the sources by a model whose reply repeats, invents and leaves out phrases."""
    phrases = table(spark, sf, "documents").groupBy(F.col("source").alias("phrase")).agg(F.min("doc_id").alias("ord"))

    def ask(system: str, user: str) -> str:
        listed = [line.partition(". ")[2] for line in user.split("\n") if line[:1].isdigit()]
        return f'{{"clusters":[{{"name":"First","mainPhrase":"nothing","phrases":["{listed[0]}","invented","{listed[1]}"]}},{{"name":"Again","mainPhrase":"x","phrases":["{listed[0]}"]}}]}}'

    found = cluster_phrases(phrases, "semantic", writer=CallableWriter(ask))
    return found.select("rank", "name", "main_phrase", F.array_join("phrases", "|").alias("phrases"))


@query("SELECT DISTINCT lang, md5(lang) AS first, 3 AS size FROM documents")
def provided_embeddings(spark, sf):
    """Texts with the vectors of a provider and a cache that has some of them."""
    langs = table(spark, sf, "documents").select("lang").distinct().select("lang", F.col("lang").alias("text"))
    vector = lambda text: F.array(F.ascii(text).cast("double"), F.length(text).cast("double"), F.lit(1.0))
    provider = TableEmbedder(langs.select("text", vector(F.col("text")).alias("embedding")), "m")
    cache = langs.where("lang < 'f'").select(F.lit("m").alias("model"), F.sha2("text", 256).alias("hash"), vector(F.col("text")).alias("embedding"))
    got, _ = embedded(langs, provider, cache)
    return got.where(F.col("embedding")[0] == F.ascii("text")).select("lang", F.md5("text").alias("first"), F.size("embedding").alias("size"))


@query("SELECT x.vec_id AS i, y.vec_id AS j, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS similarity FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def neighbour_cosines(spark, sf):
    """Cosine as a column, of each vector and the next."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    x, y = v.select(F.col("vec_id").alias("i"), F.col("embedding").alias("x")), v.select(F.col("vec_id").alias("j"), F.col("embedding").alias("y"))
    return x.join(y, F.col("j") == F.col("i") + 1).select("i", "j", F.round(cosine(F.col("x"), F.col("y")), 9).alias("similarity"))


@query(
    f"""WITH t AS (SELECT item_id, list_distinct({_tokens_sql('text')}) AS t FROM benchmark)
SELECT x.item_id AS i, y.item_id AS j, round(len(list_intersect(x.t, y.t))::DOUBLE / least(len(x.t), len(y.t)), 9) AS similarity FROM t x JOIN t y ON x.item_id < y.item_id AND len(x.t) > 0 AND len(y.t) > 0 WHERE len(list_intersect(x.t, y.t))::DOUBLE / least(len(x.t), len(y.t)) >= 0.1"""
)
def overlapping_items(spark, sf):
    """Short texts by overlap of their tokens, at a low threshold."""
    sets = table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), token_set(F.col("text")).alias("tokens"))
    return similar_pairs(sets, 0.1, "overlap").withColumn("similarity", F.round("similarity", 9))


@query("WITH a AS (SELECT conv_id, turn, unnest([trim(text), NULL, '', text || ' ']) AS phrase, unnest([0, 1, 2, 3]) AS pos FROM conversations) SELECT conv_id, phrase, min(turn * 4 + pos)::BIGINT AS ord FROM (SELECT conv_id, turn, pos, trim(phrase) AS phrase FROM a) WHERE phrase <> '' GROUP BY conv_id, phrase")
def body_phrases(spark, sf):
    """Phrases of request bodies: arrays in JSON, of which only strings count, trimmed and each once."""
    turns = table(spark, sf, "conversations")
    text = F.col("text")
    item = F.to_json(F.struct(F.array(F.trim(text), F.lit(None).cast("string"), F.lit(""), F.concat(text, F.lit(" "))).alias("phrases")), {"ignoreNullFields": "false"})
    return requested_phrases(turns.select("conv_id", (F.col("turn") * 4).alias("at"), item.alias("body")), ("conv_id",)).select("conv_id", "phrase", "ord")


@query(f"WITH RECURSIVE {_limit_sql('g', 'TRUE', 2, DAY)} SELECT event_id AS request_id, 'k' || user_id AS client_key, ok AS allowed, wait AS retry_after FROM g")
def rate_limited_stream(spark, sf):
    """The same budget as keyed state of a stream that reads the table, all of it in one micro-batch."""
    path = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    asked = raw.select(F.col("event_id").alias("request_id"), F.concat(F.lit("k"), "user_id").alias("client_key"), F.col("ts").cast("timestamp").alias("ts"))
    run = rate_limit_stream(asked, Budget(2, DAY)).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query(_cases(("a at 0", "(True, 0)"), ("a at 1", "(False, 1)"), ("b at 1", "(True, 0)"), ("c at 900 sweeps nothing", "(True, 0)"), ("a again at 950", "(False, 1)"), ("d short budget at 1200 sweeps a, b", "(True, 0)"), ("a with its long budget at 1300", "(True, 0)"), ("held", "['a', 'c', 'd']")))
def evicted_keys(spark, sf):
    """A limiter of one process that tracks two keys: beyond that, keys go whose window is over by the current budget."""
    limiter, long, short = Limiter(2), Budget(1, 1000), Budget(1, 500)
    asked = {
        "a at 0": lambda: limiter.admit("a", 0, Budget(1, 1000)), "a at 1": lambda: limiter.admit("a", 1, long), "b at 1": lambda: limiter.admit("b", 1, long), "c at 900 sweeps nothing": lambda: limiter.admit("c", 900, long), "a again at 950": lambda: limiter.admit("a", 950, long),
        "d short budget at 1200 sweeps a, b": lambda: limiter.admit("d", 1200, short), "a with its long budget at 1300": lambda: limiter.admit("a", 1300, long), "held": lambda: sorted(limiter.states),
    }
    return _answers(spark, asked)


@query(_cases(("1", '{"type": "status", "message": "started"}\n'), ("2", '{"type": "status", "message": "3 rows", "fetched": 3, "total": 5}\n'), ("3", '{"type": "status", "message": "5 rows", "fetched": 5, "total": 5}\n'), ("4", '{"type": "done", "result": "5"}\n')))
def progress_events(spark, sf):
    """The lines that a listener sends while a stream runs."""
    from types import SimpleNamespace as Is

    sent: list[str] = []
    listener = Progress(sent.append, 5)
    listener.onQueryStarted(None)
    for n in (3, 2):
        listener.onQueryProgress(Is(progress=Is(numInputRows=n)))
    listener.onQueryTerminated(Is(exception=None))
    return spark.createDataFrame([(str(i), line) for i, line in enumerate(sent, 1)], "request string, answer string")
