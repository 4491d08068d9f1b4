"""Full-text search: weighted BM25 over postings, phrases, and the lookup cascade."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.functions import ids, text
from quire.sources.shared import materialize, small_side

#: Column weights, and BM25's saturation and length parameters.
WEIGHTS = {"title": 10.0, "authors": 5.0, "abstract": 3.0, "body": 1.0, "descriptions": 0.5}
K1, B = 1.2, 0.75


def parse(query: str) -> list[list[str]]:
    """A query's phrases, each a list of folded words: quoted parts and single words, all of which must occur."""
    import unicodedata

    low = "".join(c for c in unicodedata.normalize("NFKD", query.casefold()) if not unicodedata.combining(c))
    parts = [re.findall(r"[^\W_]+", quoted or word) for quoted, word in re.findall(r'"([^"]*)"|(\S+)', low)]
    return [p for p in parts if p]


def postings(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, pos, term) for every word of the columns."""
    each = [rows.select(key, F.lit(c).alias("field"), F.posexplode(text.words(F.coalesce(F.col(c), F.lit("")))).alias("pos", "term")) for c in columns]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def bm25(rows: DataFrame, key: str, columns: list[str], query: str, k: int, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(key, score): the k best rows for a query, lower scores better; ties to the smaller key.

    Counts phrases in each row's words in place, in one pass over the texts; the corpus statistics are one
    small aggregate of the counts. ``bm25_index`` answers from stored postings instead.
    """
    phrases = parse(query)
    if not phrases:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    # all counts are made inside one lambda, whose argument is computed once a row wherever the optimizer moves it
    toks = F.struct(*(text.words(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns))

    def hits(words: Column, phrase: list[str]) -> Column:
        at = lambda i: F.get(words, i) == phrase[0]
        if len(phrase) == 1:
            return F.size(F.filter(words, lambda x: x == phrase[0])).cast("double")
        starts = F.filter(F.sequence(F.lit(0), F.size(words)), at)
        rest = lambda i: F.forall(F.array(*(F.get(words, i + j) == w for j, w in enumerate(phrase[1:], 1))), lambda x: F.coalesce(x, F.lit(False)))
        return F.size(F.filter(starts, rest)).cast("double")

    def counts(row: Column) -> Column:
        add = lambda parts: sum(parts[1:], parts[0])
        terms = [add([F.lit(weights[c]) * hits(row[c], p) for c in columns]).alias(f"tf{j}") for j, p in enumerate(phrases)]
        return F.struct(add([F.size(row[c]) for c in columns]).cast("double").alias("d"), *terms)

    # a narrow table, stored, as both the statistics and the hits are read from it
    counted = materialize(rows.select(key, F.element_at(F.transform(F.array(toks), counts), 1).alias("c")).select(key, "c.*"), "counted")
    stats = counted.agg(F.count(F.lit(1)).cast("double").alias("n_all"), F.avg("d").alias("avgdl"), *(F.count_if(F.col(f"tf{j}") > 0).cast("double").alias(f"df{j}") for j in range(len(phrases))))
    hit = counted.where(" and ".join(f"tf{j} > 0" for j in range(len(phrases)))).crossJoin(F.broadcast(stats))  # one row of statistics
    return _ranked(hit, key, len(phrases), k)


def _term_spots(words: Column) -> Column:
    """(term, spots) of each distinct word of an array: its places, in order. One sort of the row's own words; nothing is shuffled."""

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i)["term"] != F.get(w, i - 1)["term"]))
        pairs = F.struct(w.alias("w"), starts.alias("s"))
        return text.once(pairs, lambda p: F.transform(p["s"], lambda i, k: F.struct(F.get(p["w"], i)["term"].alias("term"), F.transform(F.slice(p["w"], i + 1, F.coalesce(F.get(p["s"], k + 1), F.size(p["w"])) - i), lambda x: x["pos"]).alias("spots"))))

    placed = F.array_sort(F.transform(words, lambda x, i: F.struct(x.alias("term"), i.alias("pos"))))
    none = F.array().cast("array<struct<term: string, spots: array<int>>>")
    return text.once(placed, lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(none))


def index_terms(rows: DataFrame, key: str, columns: list[str], path: str, buckets: int = 64) -> None:
    """Store an index of ``rows`` at ``path``: postings in folders by the term's hash, and each row's length.

    A term's postings are one row a document: its places in each field, gathered within the document's own row. Postings are
    shuffled once, to their folders; terms so frequent that they would fill a task are spread by the adaptive writer.
    """
    each = [rows.select(key, F.lit(c).alias("field"), F.inline(_term_spots(text.words(F.coalesce(F.col(c), F.lit("")))))) for c in columns]
    spots = reduce(lambda a, b: a.unionByName(b), each).select("term", key, "field", "spots")
    spots.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
    sizes = [F.size(text.words(F.coalesce(F.col(c), F.lit("")))) for c in columns]
    rows.select(key, reduce(lambda a, b: a + b, sizes).cast("double").alias("d")).write.parquet(f"{path}/lengths")


def bm25_index(spark: SparkSession, key: str, path: str, query: str, k: int, weights: dict[str, float] = WEIGHTS, buckets: int = 64) -> DataFrame:
    """``bm25`` from an index of ``index_terms``: only the folders of the query's terms are read.

    A phrase is found by its words' places: those of word j, less j, that all of its words share.
    """
    phrases = parse(query)
    lengths = spark.read.parquet(f"{path}/lengths")
    if not phrases:
        return lengths.select(key, F.lit(0.0).alias("score")).limit(0)
    words = sorted({w for p in phrases for w in p})
    homes = [r.b for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.pmod(F.xxhash64("w"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()]  # the query's words
    found = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(homes) & F.col("term").isin(words))
    per = found.groupBy(key, "field").agg(F.collect_list(F.struct("term", "spots")).alias("m"))  # as many entries as the query has words
    spots = lambda w: F.flatten(F.transform(F.filter("m", lambda e: e["term"] == w), lambda e: e["spots"]))
    shifted = lambda w, j: F.transform(spots(w), lambda x: x - j)
    count = lambda p: F.size(reduce(F.array_intersect, [shifted(w, j) for j, w in enumerate(p)])) if len(p) > 1 else F.size(spots(p[0]))
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("field"))
    counted = per.groupBy(key).agg(*(F.sum(weight * count(p)).alias(f"tf{j}") for j, p in enumerate(phrases)))
    counted = materialize(counted, "counted")
    stats = lengths.agg(F.count(F.lit(1)).cast("double").alias("n_all"), F.avg("d").alias("avgdl")).crossJoin(counted.agg(*(F.count_if(F.col(f"tf{j}") > 0).cast("double").alias(f"df{j}") for j in range(len(phrases)))))
    hit = counted.where(" and ".join(f"tf{j} > 0" for j in range(len(phrases)))).join(lengths, key)
    return _ranked(hit.crossJoin(F.broadcast(stats)), key, len(phrases), k)  # one row of statistics


def _ranked(hit: DataFrame, key: str, n: int, k: int) -> DataFrame:
    """The k best of rows with tf0, tf1, ..., their length d and the corpus's n_all, avgdl and df0, df1, ..."""
    idf = lambda j: F.greatest(F.log((F.col("n_all") - F.col(f"df{j}") + 0.5) / (F.col(f"df{j}") + 0.5)), F.lit(1e-6))
    part = lambda j: idf(j) * F.col(f"tf{j}") * (K1 + 1) / (F.col(f"tf{j}") + K1 * (1 - B + B * F.col("d") / F.col("avgdl")))
    return hit.select(key, (-reduce(lambda a, b: a + b, (part(j) for j in range(n)))).alias("score")).orderBy("score", key).limit(k)


def merged(results: list[DataFrame], key: str) -> DataFrame:
    """Results of several libraries, (library, key, score), in one order; each library keeps its own best k."""
    out = reduce(lambda a, b: a.unionByName(b), results)
    return out.orderBy("score", "library", key)


def snippet(body: str, query: str, width: int = 12) -> Column:
    """``width`` words of a text from a little before its first hit, hits in brackets.

    A word is a hit if one of the words it folds to is a word of the query, whatever marks and punctuation it has.
    """
    wanted = F.array(*(F.lit(w) for p in parse(query) for w in p))

    def shown(w: Column) -> Column:
        hits = F.transform(w, lambda x: F.arrays_overlap(text.words(x), wanted))
        start = F.greatest(F.lit(1), F.array_position(hits, F.lit(True)).cast("int") - 2)
        return F.array_join(F.zip_with(F.slice(w, start, width), F.slice(hits, start, width), lambda x, hit: F.when(hit, F.concat(F.lit("["), x, F.lit("]"))).otherwise(x)), " ")

    return F.element_at(F.transform(F.array(F.split(F.col(body), r"\s+")), shown), 1)


def lookup(queries: DataFrame, steps: list[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """(query, directory, held, status, reason): each query's evidence, the strongest for a directory; else absent.

    ``steps``, strongest first: status, reason, evidence (value, directory) and the query's column to match, one value or
    an array. Directories that share a value are one class: its first directory stands for it, and ``held`` counts it, so
    that copies are never expanded into pairs.
    """
    found = None
    for rank, (status, reason, table, column) in enumerate(steps):
        classes = table.where("value is not null").groupBy("value").agg(F.min("directory").alias("directory"), F.count_distinct("directory").alias("held"))
        value = F.explode(F.col(column)) if isinstance(queries.schema[column].dataType, T.ArrayType) else F.col(column)
        asked = queries.select("query", value.alias("value")).where("value is not null")
        hit = asked.join(classes.hint("merge"), "value").select("query", "directory", "held", F.lit(rank).alias("rank"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy("query", "directory").agg(F.min(F.struct("rank", "status", "reason", "held")).alias("b")).select("query", "directory", "b.held", "b.status", "b.reason")
    return with_absent(queries, best)


def with_absent(queries: DataFrame, best: DataFrame) -> DataFrame:
    """``best`` with a row ``absent`` for each of the ``queries`` that has no evidence."""
    none = F.lit(None).cast(best.schema["directory"].dataType)
    absent = queries.select("query").distinct().join(best.select("query").distinct().hint("merge"), "query", "left_anti").select("query", none.alias("directory"), F.lit(0).cast("long").alias("held"), F.lit("absent").alias("status"), F.lit("").alias("reason"))
    return best.select("query", "directory", "held", "status", "reason").unionByName(absent)


def lookup_library(queries: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """``lookup`` by all evidence there is, strongest first.

    ``queries``: query, sha256, text_sha256, arxiv, arxiv_candidates, doi, doi_candidates, title, author, year, first_page.
    ``index``: sources (directory, sha256), texts (directory, text_sha256), arxiv (directory, identifier), papers
    (directory, doi, title_key, title_key_observed, families, year), candidates (directory, doi). Bytes and text come first,
    then identifiers of the file, identifiers it mentions, similar titles, and titles that the first page prints. Each kind of
    evidence is stored once, as narrow rows, and joins are told to sort: estimates from small files would send whole sides to the driver.
    """
    bare = lambda c: F.transform(F.col(c), ids.arxiv_base)
    asked = queries.withColumns({"_arxiv": ids.arxiv_base(F.col("arxiv")), "_mentioned": bare("arxiv_candidates"), "_doi": F.lower("doi"), "_dois": F.transform("doi_candidates", F.lower)})
    table = lambda name, column: index[name].select(F.lower(column).alias("value"), "directory")
    steps = [
        ("present", "identical bytes", table("sources", "sha256"), "sha256"),
        ("present", "identical text on every page", table("texts", "text_sha256"), "text_sha256"),
        ("present", "arXiv identifier", table("arxiv", "identifier"), "_arxiv"),
        ("present", "validated DOI", table("papers", "doi"), "_doi"),
        ("related", "the file mentions the paper's arXiv identifier", table("arxiv", "identifier"), "_mentioned"),
        ("related", "the file mentions the paper's DOI", table("papers", "doi"), "_dois"),
        ("related", "both mention a DOI", table("candidates", "doi"), "_dois"),
    ]
    sure = materialize(lookup(asked, steps).where("status <> 'absent'"), "sure")
    titled = title_matches(queries, index["papers"]).select("query", "directory", F.lit(1).cast("long").alias("held"), F.lit("candidate").alias("status"), F.lit("similar titles; titles alone never prove identity").alias("reason"))
    titled = materialize(titled, "titled")
    keys = index["papers"].where("title_key <> ''").select(F.col("directory").alias("title_id"), F.col("title_key").alias("key"))
    pages = queries.where("first_page is not null").select(F.col("query").alias("page_id"), text.title_key(F.col("first_page")).alias("page_key"))
    printed = printed_titles(keys, pages).select(F.col("page_id").alias("query"), F.col("title_id").alias("directory"), F.lit(1).cast("long").alias("held"), F.lit("candidate").alias("status"), F.lit("the first page prints the paper's title").alias("reason"))
    weaker = titled.unionByName(printed.join(titled.select("query", "directory").hint("merge"), ["query", "directory"], "left_anti"))
    best = materialize(sure.unionByName(weaker.join(sure.select("query", "directory").hint("merge"), ["query", "directory"], "left_anti")), "best")
    return with_absent(queries, best)


#: How far two years may be apart for one paper.
YEAR_TOLERANCE = 1


def title_matches(queries: DataFrame, papers: DataFrame, least: float = 0.8) -> DataFrame:
    """(query, directory, overlap): papers whose title, validated or observed, has ``least`` of the words' union with a query's.

    ``queries``: query, title, author, year; ``papers``: directory, title_key, title_key_observed, families, year. Where the
    query names an author, one of the paper's family names must contain it; where both have a year, they must be near.
    Pairs are found by a prefix filter: the rarest words of two such titles have one in common.
    """
    keys = F.array_compact(F.array("title_key", "title_key_observed"))
    left = queries.where("title is not null").select(F.col("query").alias("id"), text.title_key(F.col("title")).alias("k"))
    right = papers.select(F.col("directory").alias("id"), F.explode(F.array_distinct(keys)).alias("k"))
    pairs = _similar(left, right, least, between=True).groupBy("a", "b").agg(F.max("overlap").alias("overlap"))
    rows = pairs.join(queries.select(F.col("query").alias("a"), "author", F.col("year").alias("_asked")).hint("merge"), "a").join(papers.select(F.col("directory").alias("b"), "families", "year").hint("merge"), "b")
    wanted = text.title_key(F.col("author"))
    fits = F.col("author").isNull() | F.exists(F.coalesce("families", F.array().cast("array<string>")), lambda f: F.contains(text.title_key(f), wanted))
    near = F.col("_asked").isNull() | F.col("year").isNull() | (F.abs(F.col("_asked") - F.col("year")) <= YEAR_TOLERANCE)
    return rows.where(fits & near).select(F.col("a").alias("query"), F.col("b").alias("directory"), "overlap")


def _similar(left: DataFrame, right: DataFrame, least: float, between: bool) -> DataFrame:
    """(a, b, overlap) of rows (id, k) whose blank-separated words overlap by ``least`` of their union; a < b unless ``between``.

    Words are stored once. No side of a join is small because its file is, so none is broadcast.
    """
    split = lambda rows: materialize(rows.select("id", F.array_distinct(F.filter(F.split("k", " "), lambda w: w != "")).alias("w")).where(F.size("w") > 0).withColumn("n", F.xxhash64("w")), "words")
    left = split(left)
    right = split(right) if between else left
    words = left.unionByName(right) if between else left
    rarity = words.select(F.explode("w").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("often"))

    slack = 1e-9  # sizes times a fraction are rounded so that no pair at the limit is lost

    def prefix(rows: DataFrame) -> DataFrame:
        ranked = rows.select("id", "n", F.size("w").alias("size"), F.explode("w").alias("t")).join(rarity.hint("merge"), "t").withColumn("r", F.row_number().over(Window.partitionBy("id", "n").orderBy("often", "t")))
        return ranked.where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * least - slack) + 1).select("id", "n", "size", "r", "t")

    def met(small: DataFrame, large: DataFrame, fits: Column) -> DataFrame:
        """Pairs (s, l) of a row and one of its size or larger that share a word of both prefixes."""
        # of a pair, the smaller one shares at least 2 * least / (1 + least) of its words: its prefix is shorter, and frequent words seldom reach it
        short = small.where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * (2 * least / (1 + least)) - slack) + 1).alias("s")
        return short.join(large.alias("l").hint("merge"), (F.col("s.t") == F.col("l.t")) & (F.col("s.size") <= F.col("l.size")) & (F.col("l.size") * least - slack <= F.col("s.size")) & fits)

    sides = lambda a, b: [F.col(f"{a}.id").alias("a"), F.col(f"{a}.n").alias("na"), F.col(f"{b}.id").alias("b"), F.col(f"{b}.n").alias("nb")]
    if between:
        a, b = prefix(left), prefix(right)
        pairs = met(a, b, F.lit(True)).select(*sides("s", "l")).unionByName(met(b, a, F.col("s.size") < F.col("l.size")).select(*sides("l", "s"))).distinct()
    else:
        a = prefix(left)
        first = F.col("s.id") < F.col("l.id")
        pick = lambda x, y: F.when(first, x).otherwise(y)
        pairs = met(a, a, (F.col("s.id") != F.col("l.id")) & ((F.col("s.size") < F.col("l.size")) | first)).select(*(pick(F.col(f"s.{c}"), F.col(f"l.{c}")).alias(n) for c, n in (("id", "a"), ("n", "na"))), *(pick(F.col(f"l.{c}"), F.col(f"s.{c}")).alias(n) for c, n in (("id", "b"), ("n", "nb")))).distinct()
    full = lambda rows, c: rows.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("w").alias(f"w_{c}"))
    overlap = F.size(F.array_intersect("w_a", "w_b")) / F.size(F.array_union("w_a", "w_b"))
    return pairs.join(full(left, "a").hint("merge"), ["a", "na"]).join(full(right, "b").hint("merge"), ["b", "nb"]).select("a", "b", overlap.alias("overlap")).where(F.col("overlap") >= least)


def similar_titles(rows: DataFrame, key: str, title: str, least: float = 0.8) -> DataFrame:
    """(a, b, overlap): pairs of keys whose titles' words overlap by ``least`` of their union.

    Prefix filter: of the larger title's words, rarest first, one of the first n - ceil(least * n) + 1 must be shared, and of
    the smaller one's one of the first n - ceil(2 * least / (1 + least) * n) + 1.
    """
    return _similar(rows.select(F.col(key).alias("id"), F.col(title).alias("k")), rows, least, between=False)


def printed_titles(titles: DataFrame, pages: DataFrame, least_words: int = 4) -> DataFrame:
    """(title_id, page_id): title keys of four words or more that begin at a word of the page's key.

    The last word may be a prefix. Titles are found by their first three words, which every page that
    prints them has as a run; only ids and runs meet, and a page's key joins the pairs found, once a page.
    """
    head = titles.where(F.size(F.split("key", " ")) >= least_words).withColumn("head", F.array_join(F.slice(F.split("key", " "), 1, 3), " "))
    threes = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " ")))
    stored = materialize(pages.select("page_id", "page_key"), "pages")
    runs = stored.select("page_id", F.explode(F.element_at(F.transform(F.array(F.split(F.col("page_key"), " ")), threes), 1)).alias("head"))
    pairs = runs.join(small_side(materialize(head, "titles"), 100_000), "head").groupBy("page_id").agg(F.collect_set(F.struct("title_id", "key")).alias("met"))
    sure = F.filter("met", lambda t: F.contains(F.concat(F.lit(" "), "page_key", F.lit(" ")), F.concat(F.lit(" "), t["key"])))
    return stored.join(pairs, "page_id").select(F.explode(sure).alias("t"), "page_id").select("t.title_id", "page_id").distinct()
