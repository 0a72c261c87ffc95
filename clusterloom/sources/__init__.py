"""Where pages come from: robots rules, sitemaps, links, crawls and guarded fetches."""
