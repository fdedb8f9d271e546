"""Rows that queries once failed on or told apart from their SQL."""

import json

from pyspark.sql import functions as F

from strataloom.functions import payload, text


def test_articles_of_very_long_texts(spark):
    """Strings of any length, with escapes and brackets in them, do not exhaust the stack."""
    long = 'say \\ "no" [{' * 20_000
    tree = json.dumps({"page": {"items": [{"id": "1", "title": "t", "html": long}]}})
    df = spark.createDataFrame([("a", tree, "1")], "k string, j string, id string")
    assert 4 <= df.select(payload.json_depth(F.col("j"))).first()[0] <= 5
    r = payload.article_record(df, ["k"], "j", "id").first()
    assert (r.status, r.path, r.html) == ("ok", "root.page.items[0]", long)


def test_closed_references_alone(spark):
    """A reference that is cut off stays where only closed ones are decoded."""
    page = "<h1>a &amp;&amp</h1><p>&copy; &quot &#39; &#39 &notit;</p>"
    df = spark.createDataFrame([(page,)], "h string")
    r = df.select(text.visible_text(F.col("h"), unicode=False, closed=True).alias("t"), text.visible_lines(F.col("h"), closed=True).alias("l"), text.visible_text(F.col("h")).alias("all")).first()
    assert r.t == "a &&amp © &quot ' &#39 &notit;" and r.l == ["a &&amp", "© &quot ' &#39 &notit;"] and r.all == "a && © \" ' ' ¬it;"


def test_places_of_texts_that_overlap_themselves(spark):
    """The shortcut for texts at their own place gives what the search gives, overlapping and repeated texts included."""
    from strataloom.operators import registry

    row = lambda at, raw: (at, 1, "牛马", "", raw, True)
    pages = [
        ("own", "x 012期a0 x", [row(2, "012期a0")]), ("moved", "x 012期a0 x", [row(0, "012期a0")]),
        ("again", "0期0期0", [row(0, "0期0")]), ("within", "0期0期0", [row(2, "0期0")]),  # a search steps over what begins within a match
        ("twice", "ab cd ab cd", [row(0, "ab cd"), row(6, "ab cd")]), ("same", "ab cd", [row(0, "ab cd"), row(0, "ab cd")]),
        ("spread", "ab  cd", [row(0, "ab cd")]), ("absent", "ab cd", [row(0, "xy")])]
    df = spark.createDataFrame([(k, "ok", r, t) for k, t, r in pages], f"k string, status string, rows {'array<' + registry.ROW + '>'}, scope string")
    got = {r.k: (r.status, [x.position for x in r.rows]) for r in registry.placed(df).collect()}
    bad = ("field_validation", [])
    assert got == {"own": ("ok", [2]), "moved": ("ok", [2]), "again": ("ok", [0]), "within": ("ok", [0]), "twice": ("ok", [0, 6]), "same": bad, "spread": ("ok", [0]), "absent": bad}


def test_a_row_is_searched_once_at_most(spark):
    """The plan that proves a row's place holds one search of the page, where it once held it wherever its result is named."""
    from strataloom.operators import registry

    df = spark.createDataFrame([], f"k string, status string, rows {'array<' + registry.ROW + '>'}, scope string")
    plan = registry.placed(df)._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(scope") == 2


def test_equal_runs_counted_without_pairs(spark):
    """The numbers of pairs by size of groups equal those of the pairs, gaps and several runs of a pair included."""
    import random

    from strataloom.operators import audit

    rnd = random.Random(4)
    rows = [(u, d, rnd.choice("ab")) for u in range(40) for d in range(1, 11) if rnd.random() < 0.9] + [(99, 3, None)]
    df = spark.createDataFrame(rows, "u int, d int, t string")
    pairs = [r.classification for r in audit.equal_runs(df, "u", "d", ["t"]).collect()]
    counts = audit.run_counts(df, "u", "d", ["t"], list(range(1, 11)))
    assert tuple(counts.first()) == (pairs.count("duplicate"), pairs.count("suspicious"))
    assert "Join" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(audit.run_counts(df.limit(0), "u", "d", ["t"], list(range(1, 11))).first()) == (0, 0)


def test_rows_at_their_own_places_are_not_folded(spark):
    """Pages whose rows all stand at different places of their own need no fold; what has a doubtful row is still walked through."""
    from strataloom.operators import registry

    row = lambda at, raw: (at, 1, "牛马", "", raw, True)
    pages = [("clear", "ab cd ab cd", [row(6, "ab cd"), row(0, "ab cd")]), ("equal", "ab cd", [row(0, "ab"), row(0, "ab cd")]), ("none", "ab", []), ("moved", "ab cd", [row(0, "ab"), row(1, "cd")])]
    df = spark.createDataFrame([(k, "ok", r, t) for k, t, r in pages], f"k string, status string, rows {'array<' + registry.ROW + '>'}, scope string")
    got = {r.k: (r.status, [(x.position, x.raw) for x in r.rows]) for r in registry.placed(df).collect()}
    assert got == {"clear": ("ok", [(0, "ab cd"), (6, "ab cd")]), "equal": ("field_validation", []), "none": ("ok", []), "moved": ("ok", [(0, "ab"), (3, "cd")])}
    before, _, fold = registry.placed(df)._jdf.queryExecution().analyzed().toString().partition("aggregate(rows")
    assert "forall(rows" in before and fold


def test_equal_runs_shuffle_no_pair(spark, monkeypatch):
    """Runs as told by comparing all pairs, over gaps and several blocks of a group; pairs are made where their sources meet and go no further."""
    import random

    from strataloom.operators import audit

    rnd = random.Random(7)
    monkeypatch.setattr(audit, "BLOCK", 4)
    held = {u: {d: (rnd.choice("ab"), 0.0 if u % 2 else -0.0) for d in [*range(1, 9), *range(11, 17)] if rnd.random() < 0.9} for u in range(30)}
    rows = [(f"s{u:02}", d, *v) for u, h in held.items() for d, v in h.items()]
    df = spark.createDataFrame(rows + [("s01", 30, None, 1.0), (None, 3, "a", 0.0)], "u string, d int, t string, x double")
    want = set()
    for a in held:
        for b in range(a + 1, 30):
            same, run, best = {d for d, v in held[a].items() if held[b].get(d) == v}, 0, (0, 0)
            for d in range(1, 18):
                run = run + 1 if d in same else 0
                best = max(best, (run, d))
            if best[0] >= 3:
                want.add((f"s{a:02}", f"s{b:02}", best[0], best[1], best[1] - best[0] + 1, "duplicate" if best[0] >= 6 else "suspicious"))
    runs = audit.equal_runs(df, "u", "d", ["t", "x"])
    got = [tuple(r) for r in runs.collect()]
    assert set(got) == want and len(got) == len(want) > 100
    assert dict(runs.dtypes) == {"first": "string", "second": "string", "consecutive": "bigint", "start": "int", "end": "int", "classification": "string"}
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("FlatMapGroupsInArrow") < plan.index("Aggregate")


def test_pages_are_dealt_over_all_partitions(spark):
    """Pages of few bytes are much work: they are not put together in one task for their size."""
    from strataloom.plans import sections

    pages = sections.pages(spark, "/root/testdata/sf0.001")
    assert pages.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_listings_of_any_number_of_pages_are_read(spark, tmp_path):
    """Listings of over LONGEST pages have their entries too; only the status of listings still has that limit."""
    from strataloom.plans import bundles

    spark.createDataFrame([(i, 2, "view") for i in [*range(1, 301), None, None, None]], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    ids, want = list(range(300, 0, -1)), {}
    for i, k in enumerate(ids):
        if k % 6 and k % 10:
            want.setdefault(k if k % 15 else ids[i - i % bundles.ENTRIES], (i // bundles.ENTRIES + 1, k % 365 + 1))
    got = sorted((r.place, r.page, r.period, r.url) for r in bundles.listing_scan(spark, str(tmp_path)).collect())
    assert got == [(n + 1, *want[t], f"https://l.example/t/{t}.html") for n, t in enumerate(want)] and got[-1][1] == 43
    assert [tuple(r) for r in bundles.listing_status(spark, str(tmp_path)).collect()] == [(2, bundles.LONGEST, "too_long")]
    assert "too_long" not in bundles.ORACLE["listing_scan"] and "too_long" in bundles.ORACLE["listing_status"]
