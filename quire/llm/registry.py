"""Queries of this subpackage over whole tables, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import divergence, exact_dedup, language, language_model, line_dedup, mixing, native, near_dedup, periodic, pii, quality, segmentation, topk, toxicity
from quire.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents`` at a similarity of 0.85."""
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"), percent=85)


QUERIES["op2_near_dedup"] = op2_near_dedup


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and verdicts of ``documents``, the rules learned from ``labels``."""
    found = quality.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES["op5_quality_rules"] = op5_quality_rules


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of ``documents`` takes of each."""
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES["op10_mixing"] = op10_mixing


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in ``documents``."""
    found = pii.detect(load(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = '{k}')) as long)").alias(f"n_{k}") for k in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(F.expr(pii.digest("base")), 256).alias("base_sha256"), F.expr(pii.digest("all_spans")).alias("spans"), F.size("all_spans").cast("long").alias("n_spans"))


QUERIES["op1_pii"] = op1_pii


def _fold(n: int) -> str:
    """SQL: the fold of a doc_id; that of a null id is null."""
    return f"crc32(cast(doc_id as string)) % {n}"


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of ``documents``, learned from the ``labels`` of four folds in five."""
    found = toxicity.scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), f"{_fold(5)} <> 0")
    return found.select("doc_id", F.expr(f"coalesce({_fold(5)} = 0, false)").alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted"))


QUERIES["op3_toxicity"] = op3_toxicity


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of ``documents``, learned from three folds in four."""
    found = language.identify(load(spark, sf_dir, "documents"), f"{_fold(4)} <> 2")
    return found.select("doc_id", F.expr(f"coalesce({_fold(4)} = 2, false)").alias("held_out"), "lang_pred", "score")


QUERIES["op9_language_id"] = op9_language_id


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the lines that too many documents of their source share."""
    found = line_dedup.drop_boilerplate(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "lines", "dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


QUERIES["op6_line_dedup"] = op6_line_dedup
ORACLES["op6_line_dedup"] = f"""
    WITH l AS (SELECT doc_id, source, text, x.line, x.pos FROM (
            SELECT doc_id, source, text, unnest(list_transform(string_split(text, chr(10)), lambda y, i: {{'line': y, 'pos': i}})) AS x FROM documents)),
    k AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
    total AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY source),
    bad AS (SELECT source, bare FROM (SELECT source, bare, count(DISTINCT doc_id) AS n FROM k WHERE bare <> '' GROUP BY source, bare)
            JOIN total USING (source) WHERE n >= {line_dedup.LEAST_PAGES} AND n > {line_dedup.RATIO} * n_pages),
    m AS (SELECT k.*, bad.bare IS NOT NULL AS gone FROM k LEFT JOIN bad ON k.source = bad.source AND k.bare = bad.bare),
    t AS (SELECT doc_id, source, count(*) FILTER (WHERE bare <> '') AS lines, count(*) FILTER (WHERE gone) AS dropped,
            coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM m GROUP BY doc_id, source)
    SELECT doc_id, source, lines, dropped, length(text) AS n_chars, md5(text) AS text_md5 FROM t
"""


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of ``embeddings`` by integer inner product, for every fiftieth vec_id."""
    return topk.top_k(load(spark, sf_dir, "embeddings"))


QUERIES["op8_topk_search"] = op8_topk_search
ORACLES["op8_topk_search"] = """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model scores of ``documents``, counted on six folds in seven."""
    found = language_model.perplexities(load(spark, sf_dir, "documents"), f"{_fold(7)} <> 2")
    return found.select("doc_id", F.expr(f"coalesce({_fold(7)} = 2, false)").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES["op7_lm_scoring"] = op7_lm_scoring


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each of ``documents``, and the digest of what each decodes to."""
    found = segmentation.encode(load(spark, sf_dir, "documents"))
    found = found.withColumns({"n_pieces": F.size("ids"), "ids_hash": F.xxhash64("ids")})
    return segmentation.decode(found).select("doc_id", "rank", "n_pieces", "ids_hash", "log_prob", "inclusion", F.md5("text").alias("decoded_md5"))


QUERIES["op4_sentencepiece"] = op4_sentencepiece


def _repeating(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where one document in ten, by its id's hash, repeats a stretch of its own words to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    n = lambda w: F.size(w)
    start = lambda w: (g % n(w)).cast("int")
    period = lambda w: (1 + F.floor((n(w) - start(w)) / (3 + g % 8))).cast("int")
    place = lambda i, a, p: F.when(i < a, i).otherwise(a + (i - a) % p)
    repeated = lambda w, a, p: F.array_join(F.transform(F.sequence(F.lit(0), n(w) - 1), lambda i: F.get(w, place(i, a, p))), " ")
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    text = once(native.words(F.col("text")), lambda w: F.when(n(w) > 0, once(F.struct(start(w).alias("a"), period(w).alias("p")), lambda x: repeated(w, x["a"], x["p"]))))
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of ``documents``, one in ten of them made to repeat itself."""
    found = periodic.periodic_runs(_repeating(load(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period")
    return found.select("doc_id", "n_runs", start, length, period, F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES["op11_periodic_runs"] = op11_periodic_runs


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal texts of ``documents``, blanks aside."""
    return exact_dedup.exact_duplicates(load(spark, sf_dir, "documents"))


QUERIES["op12_exact_dedup"] = op12_exact_dedup
ORACLES["op12_exact_dedup"] = r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
    k AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language of ``documents`` diverge, and on which terms."""
    return divergence.divergence(load(spark, sf_dir, "documents"))


QUERIES["op13_source_divergence"] = op13_source_divergence
ORACLES["op13_source_divergence"] = r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
    kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
    v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
    c AS (SELECT t.lang, t.source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY t.lang, t.source, term),
    g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.v) AS p,
            1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.v) AS q
        FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0::HUGEINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        UNION ALL SELECT a.lang, a.source, 'pair', b.source, sum(abs(a.p - b.p))::HUGEINT FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
    every AS (SELECT lang, source, part, item, sum(value)::BIGINT AS value FROM pair GROUP BY lang, source, part, item
        UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
    SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
    WHERE part = 'pair' OR rank <= 50
"""
