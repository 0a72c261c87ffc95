"""URLs and network addresses.

``resolve`` follows the web platform's URL parser for http and https; other
schemes count as no link. Address tests are plain column expressions.
"""

from __future__ import annotations

import ipaddress
import re
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files that are no pages, by extension of the path (fixed values).
SKIPPED = r"(?i)\.(pdf|jpe?g|png|gif|svg|webp|zip|rar|mp4|mp3|css|js|xml|json|ico|woff2?)$"
_SKIPPED = re.compile(SKIPPED)
_PORTS = {"http": "80", "https": "443"}
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_FORBIDDEN = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^`{|}\x7f]")
#: What a path and a query keep as it is (fixed values).
_PATH = frozenset("!$%&'()*+,-./0123456789:;=@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_abcdefghijklmnopqrstuvwxyz|~")
_QUERY = frozenset("!$%&()*+,-./0123456789:;=?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~")


class Url(NamedTuple):
    scheme: str
    host: str
    path: str
    query: str

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}"

    @property
    def href(self) -> str:
        return self.origin + self.path + self.query


def _encoded(text: str, keep: frozenset[str]) -> str:
    return "".join(c if c in keep else "".join(f"%{b:02X}" for b in c.encode(errors="replace")) for c in text)


def _host(raw: str) -> str | None:
    raw = raw.rpartition("@")[2]
    if raw.startswith("["):
        inside, closed, rest = raw[1:].partition("]")
        if not closed:
            return None
        try:
            name = f"[{ipaddress.IPv6Address(inside).compressed}]"
        except ValueError:
            return None
        return name + rest if re.fullmatch(r"(:[0-9]*)?", rest) else None
    name, _, port = raw.partition(":")
    if port and not (port.isascii() and port.isdigit() and int(port) < 65536):
        return None
    try:
        name = unquote_to_bytes(name).decode()
        name = name.lower() if name.isascii() else name.encode("idna").decode()
    except UnicodeError:
        return None
    if not name or _FORBIDDEN.search(name):
        return None
    last = name.rstrip(".").rpartition(".")[2]
    if re.fullmatch(r"[0-9]+|0x[0-9a-f]*", last) and (name := _ipv4(name.rstrip("."))) is None:
        return None
    return f"{name}:{int(port)}" if port else name


def _ipv4(name: str) -> str | None:
    """The dotted form of a host that ends in a number, whose parts may be octal, hexadecimal or left out."""
    parts = name.split(".")
    try:
        values = [int(p[2:] or "0", 16) if p.startswith("0x") else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p) for p in parts]
    except ValueError:
        return None
    if len(values) > 4 or any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - len(values)):
        return None
    number = sum(v << 8 * (3 - i) for i, v in enumerate(values[:-1])) + values[-1]
    return str(ipaddress.IPv4Address(number))


def _folded(segments: list[str]) -> str:
    out: list[str] = []
    for i, s in enumerate(segments):
        plain = s.lower().replace("%2e", ".")
        last = i == len(segments) - 1
        if plain == "..":
            del out[-1:]
        elif plain != ".":
            out.append(s)
        if last and plain in (".", ".."):
            out.append("")
    return "/" + "/".join(out)


def resolve(href: str, base: Url | None = None) -> Url | None:
    """An http(s) URL without its fragment; None if it is another scheme or can't be parsed."""
    text = re.sub(r"[\t\n\r]", "", href.strip("".join(map(chr, range(33)))))
    scheme, rest = base.scheme if base else "", text
    if m := _SCHEME.match(text):
        scheme, rest = m.group()[:-1].lower(), text[m.end() :]
        if scheme not in _PORTS:
            return None
        if not (base and scheme == base.scheme and not re.match(r"[/\\]", rest)):
            rest = "//" + rest.lstrip("/\\")
    elif not base:
        return None
    rest = rest.partition("#")[0]
    before, mark, query = rest.partition("?")
    query = mark + _encoded(query, _QUERY) if query else ""
    before = before.replace("\\", "/")
    if before.startswith("//"):
        raw, slash, path = before.lstrip("/").partition("/")
        host = _host(raw)
        if host is None:
            return None
        host = host.removesuffix(f":{_PORTS[scheme]}")
        return Url(scheme, host, _folded(_encoded(path, _PATH).split("/")), query)
    if not before:
        return Url(scheme, base.host, base.path, query or ("" if mark else base.query))
    segments = _encoded(before, _PATH).split("/")
    if before.startswith("/"):
        return Url(scheme, base.host, _folded(segments[1:]), query)
    return Url(scheme, base.host, _folded(base.path.split("/")[1:-1] + segments), query)


def skipped(path: str) -> bool:
    return bool(_SKIPPED.search(path))


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("href", "origin", "path")]))
def url_parts(urls: pd.Series) -> pd.DataFrame:
    """Normalised href, origin and path; nulls where a URL can't be parsed."""
    found = [resolve(u) if u is not None else None for u in urls]
    return pd.DataFrame({"href": [u and u.href for u in found], "origin": [u and u.origin for u in found], "path": [u and u.path for u in found]})


def origin(url: Column) -> Column:
    """Scheme and authority of a URL that needs no normalising."""
    return F.regexp_extract(url, r"^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)


def pathname(url: Column) -> Column:
    """Path of a URL that needs no normalising; `/` if it has none."""
    path = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def is_skipped(path: Column) -> Column:
    return path.rlike(SKIPPED)


def slug_label(url: Column) -> Column:
    """The last segment of the path as words, without an extension; the whole URL if nothing is left."""
    segment = F.element_at(F.split(F.regexp_replace(pathname(url), "/+$", ""), "/"), -1)
    words = F.btrim(F.regexp_replace(F.regexp_replace(segment, r"\.[A-Za-z0-9_]+$", ""), "[-_]+", " "))
    return F.when(words == "", url).otherwise(words)


def private_ipv4(ip: Column) -> Column:
    """Loopback, private, link-local, shared, zero, multicast and reserved addresses; also what is no address."""
    parts = F.split(ip, r"\.")
    numbers = F.transform(parts, lambda p: F.when(p.rlike(r"\A[0-9]{1,9}\z"), p.try_cast("int")))
    good = (F.size(parts) == 4) & F.forall(numbers, lambda n: n.isNotNull() & n.between(0, 255))
    a, b = F.try_element_at(numbers, F.lit(1)), F.try_element_at(numbers, F.lit(2))
    reserved = (
        a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    )
    return ~F.coalesce(good, F.lit(False)) | F.coalesce(reserved, F.lit(True))


def private_ipv6(ip: Column, strict: bool = False) -> Column:
    """Loopback, unspecified, mapped private, link-local (fe8, fe9) and unique local addresses.

    ``strict`` adds the rest of fe80::/10, multicast and mapped addresses in
    hexadecimal form.
    """
    low = F.lower(ip)
    tail = F.element_at(F.split(low, ":"), -1)
    dotted = tail.rlike(r"\A(\d{1,3}\.){3}\d{1,3}\z")
    out = low.isin("::1", "::") | (low.startswith("::ffff:") & dotted & private_ipv4(tail)) | low.rlike(r"\A(fe8|fe9|fc|fd)")
    if strict:
        out = out | low.rlike(r"\A(fea|feb|ff)") | (low.startswith("::ffff:") & ~dotted)
    return out


def private_address(ip: Column, strict: bool = False) -> Column:
    """Whether a server must not fetch from this address; true for what is no address."""
    v4 = ip.rlike(r"\A(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}\z")
    v6 = ip.contains(":") & ip.rlike(r"\A[0-9A-Fa-f:.%\w]+\z")
    return F.when(v4, private_ipv4(ip)).when(v6, private_ipv6(ip, strict)).otherwise(True)


def is_private(ip: str, strict: bool = True) -> bool:
    """The same for one address on the driver or a worker; ``strict`` asks the standard library."""
    try:
        address = ipaddress.ip_address(ip)
    except ValueError:
        return True
    mapped = getattr(address, "ipv4_mapped", None)
    if mapped:
        return is_private(str(mapped), strict)
    return not address.is_global or address.is_multicast or (strict and address.is_reserved)
