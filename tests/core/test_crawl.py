"""Closures and listings on captures written by hand: cycles, budgets, identities, what is lost."""

from pyspark.sql import functions as F

from strataloom.operators import crawl

SOURCES = "source string, url string, allowed array<string>, api string, pattern string"
H = "https://h.example"


def run(spark, pages, *sources, **limits):
    captured = spark.createDataFrame(list(pages.items()), "url string, text string")
    src = spark.createDataFrame([(s[0], s[1], s[2] if len(s) > 2 else [], "", s[3] if len(s) > 3 else "") for s in sources], SOURCES)
    documents, scans = crawl.closure(src, captured, **limits)
    got = {}
    for r in sorted(documents.collect(), key=lambda r: (r.source, r.place)):
        got.setdefault(r.source, []).append((r.url.removeprefix(H), r.depth, r.record_id, r.identity_inherited))
    return got, {r.source: (r.n_documents, r.scan_complete) for r in scans.collect()}


def frames(*to):
    return "x" + "".join(f'<iframe width=1 src="{t}">' for t in to)


def test_cycles_end_and_others_stay_out(spark):
    pages = {f"{H}/a": frames("/b", "c", "/b#x", "/a", "https://far.example/d", "/{t}"), f"{H}/b": frames("/a", "/c"), f"{H}/c": frames("/b", f"{H}/c"), "https://far.example/d": "far"}
    got, scans = run(spark, pages, ("s", f"{H}/a"), ("far", f"{H}/a", ["https://far.example"]), ("by pattern", f"{H}/a", [], "https://far\\."), ("none", f"{H}/none"))
    near = [("/a", 0, "", False), ("/b", 1, "", True), ("/c", 1, "", True)]
    assert got == {"s": near, "far": [*near, ("https://far.example/d", 1, "", True)], "by pattern": [*near, ("https://far.example/d", 1, "", True)]}
    assert scans == {"s": (3, True), "far": (4, True), "by pattern": (4, True), "none": (0, False)}


def test_identities_are_inherited_and_kept_apart(spark):
    pages = {f"{H}/topic/1": frames("/x", "/topic/2"), f"{H}/x": frames("/topic/1.html", "/topic/2"), f"{H}/topic/1.html": "t", f"{H}/topic/2": "t"}
    got, scans = run(spark, pages, ("s", f"{H}/topic/1"))
    assert got["s"] == [("/topic/1", 0, "topic:1", False), ("/x", 1, "topic:1", True), ("/topic/1.html", 2, "topic:1", False)] and scans["s"] == (3, True)


def test_budgets_and_losses(spark):
    chain = {f"{H}/{k}": frames(f"/{k + 1}") for k in range(8)}
    assert run(spark, chain, ("s", f"{H}/0"))[1]["s"] == (4, False)  # the last level refers to more
    assert run(spark, {k: v for k, v in chain.items() if k <= f"{H}/3"} | {f"{H}/3": "end"}, ("s", f"{H}/0"))[1]["s"] == (4, True)
    wide = {f"{H}/0": frames(*(f"/{k}" for k in range(1, 9)))} | {f"{H}/{k}": "t" for k in range(1, 9)}
    assert run(spark, wide, ("s", f"{H}/0"))[1]["s"] == (9, True)
    assert run(spark, wide, ("s", f"{H}/0"), nested=5)[1]["s"] == (6, False)
    got, scans = run(spark, wide, ("s", f"{H}/0"), most=4)
    assert [u for u, *_ in got["s"]] == ["/0", "/1", "/2", "/3"] and scans["s"] == (4, False)
    assert run(spark, wide | {f"{H}/4": ""}, ("s", f"{H}/0"))[1]["s"] == (8, False)


def test_order_of_scripts(spark):
    row = spark.createDataFrame([('<script src="/a.js"></script><script async src=\'/upload/script/b.js\'></script>',)], "t string").select(crawl.scripts(F.col("t")).alias("s")).first()
    assert row.s == ["/upload/script/b.js", "/a.js"]


def listing(spark, pages, **limits):
    captured = spark.createDataFrame(list(pages.items()), "url string, text string")
    src = spark.createDataFrame([("s", f"{H}/l", "", "站", ["绝杀"], "top")], "source string, url string, title string, name string, keywords array<string>, pick string")
    entries, listings = crawl.listing(src, captured, ["二肖"], **limits)
    targets = crawl.listing_targets(entries, src, 8)
    return [(r.place, r.page, r.period, r.url.removeprefix(H)) for r in sorted(entries.collect(), key=lambda r: r.place)], listings.first(), [r.slot for r in targets.collect()]


def test_listing_pages(spark):
    a = lambda href, title: f"<a class=x href='{href}'>{title}</a>"
    one = a("/t/1", "009期 站 绝杀<b>二肖</b>") + a("/t/2?x=1&amp;y=2#z", "008期站绝杀二肖") + a("/t/1", "007期 站 绝杀二肖") + a("/t/3", "008期 站 二肖") + a("/t/4", "400期站绝杀二肖") + a("#", "006期站绝杀二肖")
    further = lambda p: a("/other?p=1", "下一页") + a(f"?p={p}", "<i>下一页</i>")
    pages = {f"{H}/l": one + further(2), f"{H}/l?p=2": a("/t/5", "1008 期 008期站绝杀二肖") + a("/t/2?x=1&y=2", "001期站绝杀二肖") + further(1), f"{H}/l?p=1": a("/t/6", "005 期站绝杀二肖") + further(2)}
    entries, status, slots = listing(spark, pages)
    assert entries == [(1, 1, 9, "/t/1"), (2, 1, 8, "/t/2?x=1&y=2"), (3, 2, 8, "/t/5"), (4, 3, 5, "/t/6")]
    assert (status.n_pages, status.status) == (3, "ok") and sorted(slots) == [2, 3]
    assert listing(spark, pages, most=2)[:2] == ([], ("s", 2, "too_long")) and listing(spark, {k: v for k, v in pages.items() if "p=2" not in k})[:2] == ([], ("s", 2, "lost"))


def test_listing_without_limit(spark):
    """Chains that lead far, back to their middle, into nothing or nowhere: all pages once, in order, whatever their number."""
    page = lambda k, to: f"<a class=x href='/t/{k}'>008期 站 绝杀二肖</a>" + (f"<a class=x href='?p={to}'>下一页</a>" if to is not None else "")
    chain = lambda n, last: {f"{H}/l" + (f"?p={k}" if k else ""): page(k, k + 1 if k + 1 < n else last) for k in range(n)}
    every = lambda n: [(k + 1, k + 1, 8, f"/t/{k}") for k in range(n)]
    for n, last in ((1, None), (2, 1), (16, None), (17, 16), (41, 29)):
        assert listing(spark, chain(n, last), most=None)[:2] == (every(n), ("s", n, "ok")), (n, last)
    assert listing(spark, chain(40, 40), most=None)[:2] == ([], ("s", 41, "lost")) and listing(spark, chain(40, 40))[:2] == ([], ("s", 32, "too_long"))
    assert listing(spark, chain(32, 3))[:2] == (every(32), ("s", 32, "ok")) and listing(spark, {})[:2] == ([], ("s", 1, "lost"))


def test_listings_that_share_pages(spark):
    """Sources that begin at different pages of one cycle each read all of it, from their own page on."""
    captured = spark.createDataFrame([(f"{H}/l?p={k}", f"<a class=x href='?p={(k + 1) % 5}'>下一页</a>") for k in range(5)], "url string, text string")
    starts = spark.createDataFrame([("a", f"{H}/l?p=0"), ("b", f"{H}/l?p=3"), ("c", f"{H}/none")], "source string, url string")
    following = captured.select("url", F.concat(F.lit(f"{H}/l"), F.regexp_extract("text", r"(\?p=\d)", 1)).alias("next"))
    got = sorted((r.source, r.page, r.url.removeprefix(f"{H}/")) for r in crawl.chains(starts, following).collect())
    assert got == [(s, n + 1, f"l?p={(at + n) % 5}") for s, at in (("a", 0), ("b", 3)) for n in range(5)] + [("c", 1, "none")]
