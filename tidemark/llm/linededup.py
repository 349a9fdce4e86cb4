"""Line dedup by distinct-site spread, in DataFrame functions only.

Every line of every text is hashed; one aggregation merges, for each line hash, a
HyperLogLog sketch of the sites that carry it. Lines that occur fewer times than the
threshold can't reach it and go; of the others, those whose estimate is within
MARGIN of the threshold get an exact distinct count, the rest are decided by the
sketch (whose standard error, 1.6 % at lgK 12, is a fifteenth of the margin). A line
on at least SITES distinct sites is boilerplate: it stays in the document with the
smallest doc_id that carries it and goes from all others.

The hot side of the join back to the documents' lines is salted, so one line that a
third of all documents share is dealt over SALTS groups. The join gives the places of
the lines that go, by both hashes (96 bits); what is left is picked by place, so the work
on a text is linear in its lines, however many of them are boilerplate.

Defined results: a null site counts as one site without a name; a null text has no
lines and stays null; an empty text has one empty line. Repeated rows (the same
doc_id twice) share their fate. Ties: of documents that carry a line the smallest doc_id
keeps it, in all its rows and as often as they have it. A very long text is split into its
lines by one task; it needs memory for an array of them. An empty table gives an empty
result. Columns other than those named pass through untouched, except n_chars, which
follows the text; names that the plan needs inside are chosen so that they clash with none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.session import fresh, named

SITES = 10
MARGIN = 1.25
LG_K = 12
SALTS = 16
LEAST = 1  # characters of a line that can be boilerplate


def _hash(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.hash(line)


def spread(docs: DataFrame, sites: int = SITES, site: str = "source", least: int = LEAST) -> DataFrame:
    """Boilerplate lines as (h, g, first_doc): the line's hashes and the document that keeps it."""
    lines = docs.select("doc_id", F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.explode(F.split("text", "\n")).alias("line"))
    h, g = _hash(F.col("line"))
    lines = lines.where(F.length("line") >= least).select("doc_id", "site", h.alias("h"), g.alias("g"))
    merged = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    guess = merged.where(F.col("n") >= sites).select("h", "g", "first_doc", F.hll_sketch_estimate("sketch").alias("estimate"))
    sure = guess.where(F.col("estimate") > sites * MARGIN).select("h", "g", "first_doc")
    near = guess.where((F.col("estimate") <= sites * MARGIN) & (F.col("estimate") >= sites / MARGIN)).select("h", "g", "first_doc")
    salted = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["h", "g", "salt"]).groupBy("h", "g", "site").agg(F.min("first_doc").alias("first_doc"))
    exact = pairs.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("first_doc").alias("first_doc")).where(F.col("n") >= sites).select("h", "g", "first_doc")
    return sure.unionByName(exact)


def clean(docs: DataFrame, sites: int = SITES, site: str = "source", least: int = LEAST, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with boilerplate lines taken out of text, and the numbers of lines and of those taken out, which replace columns of these names."""
    boiler = spread(docs, sites, site, least).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own, taken, every = fresh(docs.columns, "own"), fresh(docs.columns, "gone"), fresh(docs.columns, "every")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias(own))  # hashed below the explosion, not for each line
    lines = texts.select("doc_id", own, F.posexplode(F.split("text", "\n")).alias("place", "line"))
    h, g = _hash(F.col("line"))
    lines = lines.where(F.length("line") >= least).select("doc_id", own, "place", h.alias("h"), g.alias("g"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    gone = lines.join(boiler, ["h", "g", "salt"]).where(F.col("doc_id") > F.col("first_doc")).groupBy("doc_id", own).agg(F.collect_set("place").alias(taken))
    out = docs.withColumn(own, F.xxhash64("text")).join(gone, ["doc_id", own], "left").withColumn(every, F.split("text", "\n"))
    changed = F.col(taken).isNotNull() & F.col("text").isNotNull()
    # `every` stands here twice, so the optimizer keeps it as a column and doesn't split the text anew for each place.
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col(taken)), lambda i: F.get(F.col(every), i))
    text = F.when(changed, F.array_join(left, "\n")).otherwise(F.col("text"))
    columns = {c: x for c, x in zip(docs.columns, named(docs), strict=True) if c not in counts} | {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    numbers = (F.size(every), F.when(changed, F.size(taken)).otherwise(F.lit(0)))
    return out.select(*(v.alias(k) for k, v in columns.items()), *(F.when(F.col("text").isNull(), 0).otherwise(x).cast("long").alias(c) for c, x in zip(counts, numbers, strict=True)))


def run(spark, sf_dir: str) -> DataFrame:
    found = clean(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def keep(spark, docs: DataFrame) -> DataFrame:
    """docs without boilerplate lines; a document of which nothing is left goes, its lines stay in the first document that has them."""
    lines, removed = fresh(docs.columns, "lines"), fresh(docs.columns, "removed")
    found = clean(docs, counts=(lines, removed))
    return found.where((F.col(removed) == 0) | (F.col(removed) < F.col(lines))).select(*named(docs))


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
boiler AS (
  SELECT line, min(doc_id) AS first_doc FROM lines WHERE length(line) >= {LEAST}
  GROUP BY line HAVING count(DISTINCT site) >= {SITES}),
kept AS (
  SELECT d.doc_id, d.text,
    list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(g.gone, []::VARCHAR[]), x)) AS kept
  FROM documents d LEFT JOIN (
    SELECT l.doc_id, list(DISTINCT l.line) AS gone FROM lines l JOIN boiler b ON l.line = b.line AND l.doc_id > b.first_doc GROUP BY l.doc_id) g
  ON d.doc_id = g.doc_id)
SELECT doc_id,
  coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines,
  coalesce(len(string_split(text, chr(10))) - len(kept), 0)::BIGINT AS n_removed,
  md5(coalesce(array_to_string(kept, chr(10)), '')) AS text_md5
FROM kept
"""
