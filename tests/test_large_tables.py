"""Steps whose work or memory once outgrew their tables: the same results, and the shape of their plans."""

from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import bags, compare, identity, intake, pointer_tree, resolution, search, span_tree
from quire.plans import registry

DATA = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_uncovered_holds_others_against_paragraphs_as_they_come(spark):
    """The others' runs are neither sorted nor counted before they meet the paragraphs', nor compared with each other within a text."""
    words = [f"w{i}" for i in range(40)]
    text = lambda *spans: " ".join(w for a, b in spans for w in words[a:b])
    asked = [("d", "all", text((0, 20))), ("d", "some", text((0, 8), (20, 32))), ("d", "none", text((20, 40))), ("d", "short", text((20, 31))), ("d", "twice", text((20, 32), (20, 32))), ("e", "all", text((0, 20))), (None, "all", text((0, 20))), ("d", "null", None)]
    held = [("d", text((0, 20))), ("d", text((0, 20), (0, 20))), ("e", text((18, 25))), ("f", None), (None, text((0, 20)))]
    paragraphs, others = spark.createDataFrame(asked, "doc string, pos string, text string"), spark.createDataFrame(held, "doc string, text string")

    def share(body, texts):
        runs = lambda t: {tuple(t.split()[i : i + 6]) for i in range(len(t.split()) - 5)}
        known = set().union(*map(runs, texts))
        return sum(r in known for r in runs(body)) / len(runs(body))

    want = [(d, p, share(t, [x for h, x in held if h == d and d and x])) for d, p, t in asked if t and len(t.split()) >= 12]
    got = compare.uncovered_within(paragraphs, others, ["doc", "pos"], ["doc"])
    assert sorted(map(repr, got.collect())) == sorted(repr(x) for x in got.sparkSession.createDataFrame([w for w in want if w[2] < 0.5], got.schema).collect())
    anywhere = compare.uncovered(paragraphs.where("doc = 'd'"), others, "pos")
    assert rows(anywhere) == sorted((p, s) for d, p, t in asked if d == "d" and t and len(t.split()) >= 12 and (s := share(t, [x for _, x in held if x])) < 0.5)
    assert "ShuffledHashJoin" in plan(anywhere) and "LeftSemi" in plan(anywhere)


def test_term_spots_are_gathered_in_their_row(spark):
    """Each word's places, without a shuffle of every word."""
    texts = ["b a b c a b", "", None, "x", "a " * 300 + "z", "Ünder under"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.inline(search._term_spots(text.words(F.coalesce("t", F.lit(""))))))
    want = []
    for i, t in enumerate(texts):
        words = (t or "").replace("Ü", "u").split()
        want += [(i, w, [k for k, x in enumerate(words) if x == w]) for w in set(words)]
    assert rows(frame) == sorted(want)
    assert "Exchange" not in plan(frame)


def test_index_answers_as_the_texts_do(spark, tmp_path):
    """Phrases, rows without words and a key that stands twice."""
    texts = [(1, "a b", "c a b a b"), (2, None, "b a"), (3, "", ""), (4, "b", "a b"), (5, "z", "a z b")]
    frame = spark.createDataFrame(texts, "id long, title string, body string")
    search.index_terms(frame, "id", ["title", "body"], f"{tmp_path}/once")
    for query in ('"a b" b', "a b", '"b a b"', "q"):
        assert rows(search.bm25_index(spark, "id", f"{tmp_path}/once", query, 10)) == rows(search.bm25(frame, "id", ["title", "body"], query, 10))
    search.index_terms(frame.union(frame.where("id = 4")), "id", ["title", "body"], f"{tmp_path}/twice")
    assert search.bm25_index(spark, "id", f"{tmp_path}/twice", "a b", 10).where("id = 4").count() == 2


def test_answers_are_read_behind_their_join(spark):
    """Stored answers are joined, not the works read from them."""
    lines = registry.QUERIES["search_answers"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert max(i for i, x in enumerate(lines) if "from_json" in x) < min(i for i, x in enumerate(lines) if "Join " in x)


def test_multisets_meet_by_one_grouping(spark):
    """Repeats on either side, keys of one side alone, null keys and values; counted before or not."""
    left = [("a", "1", 2), ("a", "2", 1), ("b", "1", 1), (None, "1", 3), ("c", None, 1), ("d", "x", 1), ("d", "x", 1)]
    right = [("a", "1", 1), ("a", "3", 4), ("e", "1", 2), (None, "1", 1), ("c", None, 2), ("d", "x", 3)]
    l, r = (spark.createDataFrame(x, "k string, value string, n long") for x in (left, right))  # noqa: E741
    want = [("a", 1, 2, 4), ("b", 0, 1, 0), ("c", 0, 1, 2), ("d", 2, 0, 1), ("e", 0, 0, 2)]
    for parts in (None, 3):
        got = bags.compare(l, r, "k", parts)
        assert rows(got.where("k is not null")) == want and [tuple(x) for x in got.where("k is null").collect()] == [(None, 0, 3, 1)]
        assert "Join" not in plan(got)
    made = spark.createDataFrame([("a", "1 2 1"), ("a", "2,5"), ("b", None)], "k string, t string")
    assert rows(bags.printed(made, "k", "t").groupBy("k", "value").agg(F.sum("n"))) == rows(bags.numbers(made, "k", "t")) == [("a", "1", 2), ("a", "2", 1), ("a", "2,5", 1)]


def test_large_tables_are_dealt_by_their_rows(spark, monkeypatch):
    """As many parts as the rows need, and one shuffle for all groupings."""
    monkeypatch.setattr("quire.sources.shared.TASK_ROWS", 100)
    for name in ("multiset_diff", "table_agreement", "number_multiset", "settled_searches"):
        shuffles = [x for x in plan(registry.QUERIES[name](spark, DATA)).split("\n") if "Exchange" in x]
        assert len(shuffles) == 1 and int(shuffles[0].split(", REPARTITION")[0].rsplit(" ", 1)[1].rstrip(")")) >= 60


def test_one_hit_is_the_least_and_the_greatest(spark):
    """Null hits don't count; a query of none isn't settled."""
    hits = spark.createDataFrame([("p", 0, None), ("p", 1, "z"), ("p", 1, None), ("p", 2, "x"), ("q", 0, None), ("r", 1, "a"), ("r", 0, "b"), ("r", 0, "c")], "paper string, ordinal int, hit string")
    assert rows(intake.settled_searches(hits, "paper", "ordinal", "hit")) == [("p", 1, "z"), ("r", 1, "a")]


def test_made_documents_are_dealt_before_they_grow(spark):
    """A small file's rows are dealt by key before blocks are made of them, and tables' numbers meet without a join."""
    assert "hashpartitioning(c_custkey" in plan(registry.QUERIES["comparison_counts"](spark, DATA))


def test_titles_are_read_before_they_meet_candidates(spark):
    """A document's title is cleaned once, not once a candidate; orders are dealt before candidates are made of them."""
    found = registry.QUERIES["resolved_candidates"](spark, DATA)
    assert "REPARTITION_BY_NUM" in plan(found)
    docs = spark.createDataFrame([("d", "The <i>long</i> title of it")], "doc string, title string")
    each = spark.createDataFrame([("d", f"10.1/{i}", i) for i in range(1, 7)], "doc string, doi string, rank int")
    records = spark.createDataFrame([("10.1/1", "Other"), ("10.1/3", "Long title of it | x"), ("10.1/4", None), ("10.1/5", "long-title of it"), ("10.1/6", "long title of it")], "doi string, title string")
    got = resolution.resolve(each, records, docs)
    want = [("d", "10.1/1", 3, "after_accepted"), ("d", "10.1/2", 4, "after_accepted"), ("d", "10.1/3", 1, "accepted"), ("d", "10.1/4", 5, "after_accepted"), ("d", "10.1/5", 2, "after_accepted")]
    assert rows(got) == want
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    first_join = min(i for i, x in enumerate(lines) if "Join " in x)
    assert not any("regexp_replace" in x for x in lines[:first_join])


def test_title_forms_agree_as_titles_do(spark):
    """Words that near keys drop, on either side and of both kinds; heads before dashes; misread and null titles."""
    pairs = [
        ("light field of oxygen", "light field of oxygen", "same"), ("a light b field of oxygen", "light field of x oxygen", "near"), ("light field oxygen", "light x field oxygen", "different"), ("light β field of oxygen", "light field of oxygen φ", "different"),
        ("light β field of oxygen", "light x field of oxygen", "near"), ("u light v field w of oxygen", "light field of oxygen", "different"), ("light field of oxygen | a", "x light field of oxygen — b", "near"), (None, "x", "different"), (None, None, "different"), ("", "", "same"), ("level 10 in water and oil", "level 1O in water and oi1", "near"),
    ]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = identity.title_agreement(frame, "a", "b")
    assert got.columns == ["i", "a", "b", "agreement"] and [r.agreement for r in got.orderBy("i").collect()] == [g for *_, g in pairs]


def test_supplements_are_dealt_and_their_joins_sort(spark, monkeypatch):
    """Parts are dealt by paper before objects are made of them, and no side of a join is held whole in a task."""
    monkeypatch.setattr("quire.sources.shared.TASK_ROWS", 100)
    found = plan(registry.QUERIES["supplement_links"](spark, DATA))
    assert "REPARTITION_BY_NUM" in found and found.count("SortMergeJoin") == 3 and "BroadcastHashJoin" not in found


def test_lookups_send_no_side_to_the_driver(spark):
    """Joins of evidence and of titles sort, however small the tables look: a file of 5 MB once made broadcasts of 800 MB."""
    rows = spark.range(50).selectExpr("id", "concat('large ring ', id div 2, ' in small') as k")
    papers = rows.selectExpr("id as directory", "k as title_key", "cast(null as string) as title_key_observed", "array('B ' || id div 4) as families", "1990 as year")
    asked = rows.selectExpr("id as query", "k as title", "'B ' || id div 4 as author", "1991 as year")
    titled, looked = search.title_matches(asked, papers), search.lookup(asked, [("present", "title", papers.selectExpr("title_key as value", "directory"), "title")])
    for found in (titled, looked):
        assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
    assert sorted((r.query, r.directory) for r in titled.collect()) == [(a, b) for a in range(50) for b in range(50) if a // 2 == b // 2]
    assert sorted((r.query, r.directory, r.held, r.status) for r in looked.collect()) == [(a, a // 2 * 2, 2, "present") for a in range(50)]


def test_span_documents_are_parsed_once(spark, monkeypatch):
    """Neither a second reading for lists nor a filter that the optimizer infers parses a document again; blocks are dealt by document alone."""
    kept, stored = [], span_tree.materialize
    monkeypatch.setattr(span_tree, "materialize", lambda df, label: kept.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, label))
    found = plan(registry.QUERIES["span_blocks"](spark, DATA))
    assert [x.count("parseJson") for x in kept] == [1, 0, 0, 0]
    assert "Broadcast" not in found and "Join" not in found and "REPARTITION_BY_NUM" in found
    assert not any("ENSURE_REQUIREMENTS" in x and "page" in x.split("hashpartitioning")[1] for x in found.split("\n") if "hashpartitioning" in x)


def test_pointer_items_are_dealt_to_their_order_once(spark, monkeypatch):
    """Both orders of a document's blocks come from one shuffle, above which is no other; headings are told without what items say."""
    kept, stored = {}, pointer_tree.materialize
    monkeypatch.setattr(pointer_tree, "materialize", lambda df, label: kept.setdefault(label, plan(df)) and stored(df, label))
    found = plan(registry.QUERIES["pointer_blocks"](spark, DATA))
    shuffles = [x for x in found.split("\n") if "Exchange hash" in x]
    assert "hashpartitioning(doc" in shuffles[0] and "REPARTITION_BY_NUM" in shuffles[0]
    assert "Window" in kept["rows"] and "raw" not in kept["rows"].split("Window")[1].split("Scan")[0]
