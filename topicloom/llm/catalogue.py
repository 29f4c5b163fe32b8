"""The corpus queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import bpe, language_id, licences, mixing, near_dup, neighbours, page_text, prefix_trie, quality_knn, quality_rules, sharding, url_filter, word_runs
from topicloom.llm.common import WORD, crc_mod, read, word_count, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    # Each text is read once; all later passes read sizes only.
    docs = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("n_words")), "words")
    mixed = mixing.mix(docs, size=F.col("n_words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


ORACLES["op1_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', '7', doc_id::VARCHAR)), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM d GROUP BY source),
k AS (
  SELECT *, row_number() OVER o AS i, sum(source_size) OVER o AS s_upto, sum(w) OVER o AS w_upto
  FROM s WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
a AS (SELECT sum(source_size)::DOUBLE AS total, sum(w) AS weights FROM s),
lev AS (
  SELECT i, (total - 3.0 * (s_upto - source_size)) / (weights - (w_upto - w)) AS level,
         3.0 * source_size / w AS own FROM k, a),
top AS (SELECT level FROM lev WHERE own > level ORDER BY i LIMIT 1),
t AS (
  SELECT source, source_size, least(3.0 * source_size, (SELECT level FROM top) * w) AS target FROM s),
p AS (SELECT *, round(target)::BIGINT AS words FROM t),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole FROM p),
e AS (
  SELECT d.doc_id, d.source, size, source_size, target, whole, words - whole * source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, source,
       (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM e
"""


@query
def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.nearest(vectors, F.pmod("vec_id", F.lit(100)) == 0)


@query
def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id",
        sharding.record_bytes().alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.ledger(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base-1")).alias("base_failed"),
        quality_rules.passes("full-1").alias("kept"),
        "fail_bits",
    )


ORACLES["op4_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS l
  FROM documents),
tok AS (
  SELECT r, i, x AS a, lead(x) OVER o AS b, lead(x, 2) OVER o AS c
  FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) WINDOW o AS (PARTITION BY r ORDER BY i)),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tok WHERE c IS NOT NULL),
rep AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY r),
ln AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM (SELECT r, unnest(l) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT d.r, doc_id, len(w) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
b AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_dup_lines >= 5 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_upper > 40 * word_chars THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_marks > n_words THEN 64 ELSE 0 END AS f
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       f & 3 <> 0 AS base_failed, f = 0 AS kept, f::BIGINT AS fail_bits
FROM b
"""



@query
def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per policy and rule: documents rejected, by this rule, and by no other rule of the policy."""
    return quality_rules.ablations(quality_rules.ledger(read(spark, sf_dir, "documents", "doc_id", "text")))


_POLICY_RULES = ", ".join(
    f"('{policy}', '{r.name}', {mask}, {1 << r.bit})" for policy, mask in quality_rules.POLICIES.items() for r in quality_rules.RULES if mask >> r.bit & 1
)
ORACLES["quality_rule_ablations"] = ORACLES["op4_quality_rules"].split("SELECT doc_id, n_words::BIGINT")[0] + f"""
SELECT policy, rule, count(*) FILTER (f & mask <> 0) AS rejected, count(*) FILTER (f & mask & bit <> 0) AS by_rule,
       count(*) FILTER (f & mask = bit) AS by_rule_alone
FROM b, (VALUES {_POLICY_RULES}) AS p(policy, rule, mask, bit) GROUP BY policy, rule
"""

WORD_BPE = "word_bpe_49k.json"


@query
def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    return bpe.round_trip(read(spark, sf_dir, "documents", "doc_id", "text"), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.get("matches", F.lit(0))
    found = licences.find(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id",
        best["licence"].alias("licence"),
        best["dice"].alias("dice"),
        best["notice"].alias("notice"),
        F.size("matches").cast("long").alias("n_matches"),
    )


def _licence_sql() -> str:
    grams = [
        f"({i}, '{name}', {sum(found.values())}, '{gram}', {n})"
        for i, (name, notice) in enumerate(licences.TEMPLATES)
        for found in [licences.template_bigrams(notice)]
        for gram, n in sorted(found.items())
    ]
    return rf"""
WITH g(t, licence, size, gram, n) AS (VALUES {", ".join(grams)}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
l AS (SELECT r, unnest(string_split(x, chr(10))) AS s, generate_subscripts(string_split(x, chr(10)), 1) - 1 AS line FROM d),
u AS (SELECT * FROM l UNION ALL SELECT r, x, -1 FROM d WHERE contains(x, chr(10))),
w AS (SELECT r, line, regexp_extract_all(lower(s), '[\pL\pN]+') AS w FROM u),
b AS (SELECT r, line, len(w) - 1 AS a, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) AS gram
      FROM w WHERE len(w) BETWEEN 2 AND 200),
c AS (SELECT r, line, a, gram, count(*) AS m FROM b GROUP BY ALL),
s AS (SELECT r, line, licence, 2.0::DOUBLE * sum(least(m, n)) / (a + size) AS dice
      FROM c JOIN g USING (gram) GROUP BY r, line, a, t, licence, size),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, line, licence) AS i, count(*) OVER (PARTITION BY r) AS n
      FROM s WHERE dice >= {licences.MIN_DICE})
SELECT doc_id, licence, dice, s AS notice, coalesce(n, 0)::BIGINT AS n_matches
FROM d LEFT JOIN (SELECT k.*, s FROM k JOIN u USING (r, line) WHERE i = 1) USING (r)
"""


ORACLES["op6_licence_scan"] = _licence_sql()

#: (host, path, verdict)
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number its URL ends in: bad if of low quality or toxic."""
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"/([0-9]+)[^0-9/]*/?$", 1)
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = read(spark, sf_dir, "labels", "doc_id", bad.alias("bad"))
    labelled = pages.select("url", number.try_cast("long").alias("doc_id"))
    mined = url_filter.mine(labelled.join(labels, "doc_id"))
    given = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(pages, given, mined).select("page_id", "host", "path", "rule", "verdict")


def _held_out(mod: int, rest: int) -> Column:
    return F.coalesce(crc_mod(F.col("doc_id"), mod) == rest, F.lit(False))


@query
def op8_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", _held_out(5, 0))
    labels = read(spark, sf_dir, "labels", "doc_id", F.col("quality").alias("label"))
    labels = labels.filter(~_held_out(5, 0))
    scored = quality_knn.score(docs, quality_knn.learn(docs, labels))
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0)
    return scored.select("doc_id", "held_out", "score", predicted.alias("predicted"))


@query
def op9_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", _held_out(4, 2))
    profiles = language_id.learn(docs.filter("NOT held_out"))
    return language_id.identify(docs, profiles).select("doc_id", "held_out", "lang_pred", "score")


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return near_dup.groups(docs, like=near_dup.Likeness(words=3, percent=85))


def _with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Texts as the query's contract has them: of a tenth of the documents the words from some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    cut = docs.select("doc_id", "text", g.alias("g"), words.alias("words"))
    cut = cut.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rest = F.col("n") - F.col("a")
    cut = cut.withColumn("p", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    whole = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), whole).otherwise(F.col("text")).alias("text"))


@query
def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _with_periodic_tails(read(spark, sf_dir, "documents", "doc_id", "text"))
    found = word_runs.collapse(docs)
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, period: bigint, length: bigint>")
    top = F.aggregate("runs", none, lambda best, r: F.when(more(best, r), r).otherwise(best))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("best")
    return found.withColumn("best", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        ((1000 * best["length"] - (1000 * best["length"]) % best["period"]) / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    given = given.fillna("", ["role", "text"])
    digest = prefix_trie.turn_digest(F.col("role"), F.col("text"))
    turns = written(prefix_trie.numbered(given, ["turn", "role", "text"], digest), "turns")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    convs = turns.filter("place = 1").select("conv_id")
    # A conversation starts with the first turns of the one its group of twenty is named by.
    starts = turns.filter("place <= 3").withColumnRenamed("conv_id", "giver")
    lent = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("giver"), taken.alias("taken"))
    lent = lent.join(starts, "giver").filter("place <= taken")
    own = turns.filter(F.col("place") > taken)
    columns = ["conv_id", "t1", "t2", "words", "place"]
    rebuilt = lent.select(*columns, F.lit(0).cast("long").alias("own")).unionByName(own.select(*columns, F.lit(1).cast("long").alias("own")))
    trie = prefix_trie.of_digests(rebuilt, ["own", "place"], convs)
    nodes = trie.nodes.join(prefix_trie.end_digests(trie.ends), prefix_trie.NODE, "left")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def _crc32_sql(text: str) -> str:
    """crc32 of a string of ASCII characters."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ 0xEDB88320 if byte & 1 else byte >> 1
        table.append(byte)
    start = f"list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT))"
    step = f"xor(c >> 8, ({table}::BIGINT[])[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({start}, lambda c, b: {step}), 4294967295)"


ORACLES["op12_prefix_trie"] = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
c AS (SELECT conv_id, {_crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS own, o.i, role, text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.i <= h
  UNION ALL SELECT o.conv_id, 1, o.i, role, text FROM o JOIN c USING (conv_id) WHERE o.i > h),
n AS (
  SELECT conv_id, row_number() OVER w AS d, len(regexp_extract_all(text, '[^ 	-
]+')) AS words,
         string_agg(md5(role) || md5(text), '') OVER w AS p
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
k AS MATERIALIZED (SELECT conv_id, d, md5(p) AS k, words FROM n UNION ALL SELECT conv_id, 0, '', 0 FROM c),
node AS MATERIALIZED (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM k GROUP BY d, k),
e AS (SELECT conv_id, max(d) AS d FROM k GROUP BY conv_id),
ends AS (SELECT d, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS h FROM k JOIN e USING (conv_id, d) GROUP BY d, k),
up AS MATERIALIZED (SELECT node.d, node.k, k.d AS ud, k.k AS uk FROM node JOIN k ON k.conv_id = node.conv_id AND k.d <= node.d),
child AS MATERIALIZED (SELECT ud AS d, uk AS k, count(*) AS n FROM up WHERE ud = d - 1 GROUP BY ALL),
tot AS (
  SELECT ud AS d, uk AS k, count(*) FILTER (child.n IS NULL) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved
  FROM up JOIN node USING (d, k) LEFT JOIN child USING (d, k) GROUP BY ALL),
above AS (SELECT up.d, up.k, node.conv_id AS parent FROM up JOIN node ON node.d = ud AND node.k = uk WHERE ud = up.d - 1)
SELECT conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n_convs, coalesce(child.n, 0)::BIGINT AS n_children, n_leaves,
       saved AS saved_tokens, coalesce(ends.h, sha256('')) AS ends_sha256
FROM node JOIN tot USING (d, k) LEFT JOIN child USING (d, k) LEFT JOIN ends USING (d, k) LEFT JOIN above USING (d, k)
"""


@query
def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = page_text.learn(page_text.labelled_pages(spark))
    found = page_text.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"), model)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
