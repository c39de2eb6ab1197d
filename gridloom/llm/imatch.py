"""I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the terms (lower-cased words) whose inverse document frequency lies in a band:
those in at least ``low`` and at most ``high`` of all documents. Since a document has a bounded
mean of distinct terms m, the lexicon has at most m / low terms whatever the corpus size; its bytes
are counted before it is broadcast, and beyond ``LEXICON_BYTES`` it is joined by key.

Randomised subsets: family f keeps a term with probability 2^-f by its md5, and deals the kept
terms into ``SLOTS`` subsets. A fingerprint joins, family by family and subset by subset, eight hex
digits of the md5 of the document's sorted distinct terms in that subset ("00000000": none).
Likeness is the share of equal subsets among those that hold terms of either text. The
sparse families give long texts, the dense ones short texts, subsets of about one term, which a
half edited text shares with a chance of 0.15 each. A text without any lexicon term has as fingerprint the hash of all
its terms, repeated.

Nulls count as empty texts; equal texts have equal fingerprints. Repeated rows keep their own
output rows; among rows of equal id the text decides the order. An empty table gives an empty
result. A text is held whole with its terms, whatever its length. Columns besides the id and the
text are not read, whatever their names. DataFrame functions alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._common import BLANKS, partitions, stored, table, text_bytes

SLOTS, FAMILIES, DIGITS = 16, 8, 8
LOW, HIGH = 0.001, 0.02
#: Bytes of text that a range should hold, and bytes of a lexicon that is broadcast.
RANGE_BYTES, LEXICON_BYTES = 64 << 20, 128 << 20


def terms(text: Column) -> Column:
    """Distinct lower-cased words; replacing blanks is much cheaper than a regex."""
    text = F.lower(text)
    for c in BLANKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_distinct(F.array_remove(F.split(text, " ", -1), ""))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, slots): the band's terms with the subsets that hold them."""
    text = F.coalesce("text", F.lit(""))
    count = docs.agg(F.count("*")).first()[0]
    df = docs.select(F.explode(terms(text)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = df.where((F.col("df") >= low * count) & (F.col("df") <= max(high * count, 1)))
    h = F.md5("term")
    slots = [F.when(_kept(h, f), F.lit(f * SLOTS) + F.conv(F.substring(h, 32 - f, 1), 16, 10).cast("int")) for f in range(FAMILIES)]
    return stored(band.select("term", F.array_compact(F.array(*slots)).alias("slots")), "lexicon")


def _kept(h: Column, family: int) -> Column:
    """The first ``family`` hex digits are all below 8: probability 2^-family."""
    return F.substring(h, 1, family).rlike(f"^[0-7]{{{family}}}$") if family else F.lit(True)


def _signature(parts: Column) -> Column:
    """The hashes of all subsets in order, from a map of subset number to hash; absent subsets are zeros."""
    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS * FAMILIES - 1)), lambda k: F.coalesce(F.try_element_at(parts, k), F.lit("0" * DIGITS)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subsets among those that hold terms of either text; 1 for equal fingerprints.
    a, b: the hashes as arrays, compared in one pass: 1 for a subset held, so many more if it is equal."""
    none, equal = "0" * DIGITS, 1 << 16
    points = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x != y, 1).when(x == none, 0).otherwise(equal + 1)), F.lit(0), lambda n, x: n + x)
    count = F.element_at(F.transform(F.array(points), lambda n: F.when(n == 0, 0.0).otherwise(F.shiftright(n, 16) / F.greatest(n.bitwiseAND(equal - 1), F.lit(1)))), 1)
    return F.when(a == b, 1.0).otherwise(count)


def _ranges(docs: DataFrame, n: int) -> list[int]:
    """Ids that open n ranges of about as many rows each; rows without an id come first."""
    found = docs.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / n for i in range(n)], 10 * n).alias("p")).first()["p"]
    return sorted(set(found or []))


def _range_of(opens: list[int]) -> Column:
    """The number of the range that holds an id: how many ranges but the first open at it or below. The
    starts are searched in two steps, so a row meets some 2 * sqrt(ranges) of them."""
    starts = opens[1:]
    size = max(1, math.isqrt(len(starts)))
    blocks = [starts[k : k + size] for k in range(0, len(starts), size)] or [[]]
    ids = lambda x: F.array(*(F.lit(i) for i in x)).cast("array<bigint>")
    below = lambda x: F.size(F.filter(x, lambda s: s <= F.col("doc_id")))
    block = F.greatest(below(ids([b[0] for b in blocks if b])) - 1, F.lit(0))
    return F.coalesce(block * size + below(F.element_at(F.array(*map(ids, blocks)), block + 1)), F.lit(0))


def _with_next(docs: DataFrame) -> DataFrame:
    """Adds (grp, n, wrap): the place in ascending order of id and text. A copy of each range's first row
    closes the range before it (the first range's closes the last), so ``lead`` needs no other range."""
    spark = docs.sparkSession
    opens = _ranges(docs, max(64, 4 * partitions(spark), -(-text_bytes(docs) // RANGE_BYTES)))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    if not opens:
        ordered = rows.withColumn("grp", F.lit(0)).withColumn("wrap", F.lit(0))
        heads = ordered.orderBy(F.col("doc_id").asc_nulls_first(), "text").limit(1).withColumn("wrap", F.lit(1))
        return ordered.unionByName(heads)
    # the first range also takes what lies before its opening id, and rows without one
    rows = rows.withColumn("grp", _range_of(opens))
    firsts = docs.where("doc_id is null").select("doc_id", text.alias("text")).agg(F.min("text").alias("text")).where("text is not null").withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("grp", F.lit(0))
    ids = [int(x) for x in opens]
    least = docs.agg(F.min("doc_id")).first()[0]
    heads = rows.where(F.col("doc_id").isin([least, *ids[1:]])).groupBy("grp", "doc_id").agg(F.min("text").alias("text"))
    heads = heads.unionByName(firsts.select("grp", "doc_id", "text")).withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.col("doc_id").asc_nulls_first()))).where("r = 1").drop("r")
    last = len(opens) - 1
    heads = heads.withColumn("grp", F.when(F.col("grp") == 0, last).otherwise(F.col("grp") - 1)).withColumn("wrap", F.lit(1))
    return rows.withColumn("wrap", F.lit(0)).unionByName(heads.select("doc_id", "text", "grp", "wrap"))


def fingerprinted(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next."""
    docs = docs.select("doc_id", "text")
    terms_of = lexicon(docs, low, high)
    held = terms_of.agg(F.sum(F.octet_length("term") + 4 * F.size("slots") + 64)).first()[0] or 0
    order = Window.partitionBy("grp").orderBy("wrap", F.col("doc_id").asc_nulls_first(), "text")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    placed = _with_next(docs).withColumn("n", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    both = placed.select("grp", "n", "wrap", "doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    both = both.withColumn("own", terms(F.col("text"))).withColumn("other", terms(F.col("edited"))).withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "edited")
    all_hash = lambda c: F.substring(F.md5(F.array_join(F.array_sort(c), " ")), 1, DIGITS)
    both = both.withColumn("own_all", all_hash(F.col("own"))).withColumn("other_all", all_hash(F.col("other")))
    info = F.struct("wrap", "doc_id", "n_chars", "edited_sha256", "own_all", "other_all")
    # one row a term, marked 1 for the text, 2 for the edited text, 3 for both; an empty term carries the document
    entry = lambda t, m: F.struct(t.alias("term"), F.lit(m).alias("in"))
    marked = F.concat(F.array(entry(F.lit(""), 0)), F.transform(F.array_intersect("own", "other"), lambda t: entry(t, 3)), F.transform(F.array_except("own", "other"), lambda t: entry(t, 1)), F.transform(F.array_except("other", "own"), lambda t: entry(t, 2)))
    flat = both.select("grp", "n", info.alias("info"), F.explode(marked).alias("m")).select("grp", "n", F.when(F.col("m.in") == 0, F.col("info")).alias("info"), "m.term", "m.in")
    if held <= LEXICON_BYTES:
        flat = flat.join(F.broadcast(terms_of), "term", "left")
    else:  # the rows that carry documents get keys that no term has, so they don't meet in one task
        flat = flat.withColumn("term", F.when(F.col("in") == 0, F.concat_ws(" ", F.lit(""), "grp", "n")).otherwise(F.col("term"))).join(terms_of, "term", "left")
    flat = flat.where("slots is not null or in = 0").select("grp", "n", "info", "term", "in", F.explode_outer("slots").alias("slot"))
    # the rows of a range stay in its partition: neither grouping shuffles
    hashed = lambda bit: F.array_sort(F.collect_list(F.when(F.col("in").bitwiseAND(bit) > 0, F.col("term"))))
    digest = lambda c: F.when(F.size(c) > 0, F.substring(F.md5(F.array_join(c, " ")), 1, DIGITS))
    slots = flat.groupBy("grp", "n", "slot").agg(F.first("info", True).alias("info"), hashed(1).alias("own"), hashed(2).alias("other")).select("grp", "n", "info", "slot", digest("own").alias("own"), digest("other").alias("other"))
    held = lambda c: F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull() & F.col(c).isNotNull(), F.struct("slot", c))))
    found = slots.groupBy("grp", "n").agg(F.first("info", True).alias("info"), held("own").alias("own"), held("other").alias("other"))
    of = lambda c: F.when(F.size(c) > 0, _signature(F.col(c))).otherwise(F.array_repeat(F.col(f"info.{c}_all"), SLOTS * FAMILIES))
    signed = found.select("grp", "n", *(f"info.{c}" for c in ("wrap", "doc_id", "n_chars", "edited_sha256")), of("own").alias("own"), of("other").alias("other"))
    later = signed.withColumn("next", F.lead("own").over(Window.partitionBy("grp").orderBy("n"))).where("wrap = 0")
    return later.select("doc_id", "n_chars", "edited_sha256", F.array_join("own", "").alias("fingerprint"), F.array_join("other", "").alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))


def _near_sql(a: str, b: str) -> str:
    part = lambda x: f"{x}[k*8+1:k*8+8]"
    held = f"list_filter(range({SLOTS * FAMILIES}), lambda k: {part(a)} <> '00000000' OR {part(b)} <> '00000000')"
    same = f"list_filter({held}, lambda k: {part(a)} = {part(b)})"
    return f"CASE WHEN {a} = {b} THEN CAST(1.0 AS DOUBLE) WHEN len({held}) = 0 THEN CAST(0.0 AS DOUBLE) ELSE len({same}) / CAST(len({held}) AS DOUBLE) END"


_SIG = f"""list_reduce(list_prepend('', list_transform(range({SLOTS * FAMILIES}), lambda k: CASE WHEN len(list_filter(F, lambda e: list_contains(e.slots, CAST(k AS INTEGER)))) = 0 THEN '{'0' * DIGITS}'
  ELSE md5(array_to_string(list_transform(list_filter(F, lambda e: list_contains(e.slots, CAST(k AS INTEGER))), lambda e: e.term), ' '))[1:{DIGITS}] END)), lambda x, y: x || y)"""
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS r, count(*) OVER () AS n FROM documents),
e AS (SELECT d.r, d.doc_id, d.text, d.n, x.r AS next_r, d.text[1:len(d.text) - len(d.text) // 2] || x.text[1:len(d.text) // 2] AS edited FROM d JOIN d x ON x.r = d.r % d.n + 1),
s AS (SELECT r, 0 AS ed, list_sort(list_distinct(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'))) AS ts FROM e
  UNION ALL SELECT r, 1, list_sort(list_distinct(regexp_extract_all(lower(edited), '[^\x20\x09-\x0D]+'))) FROM e),
t AS (SELECT r, ed, unnest(ts) AS term FROM s),
band AS (SELECT term FROM t WHERE ed = 0 GROUP BY term HAVING count(*) >= {LOW} * (SELECT count(*) FROM documents) AND count(*) <= greatest({HIGH} * (SELECT count(*) FROM documents), 1)),
lx AS (SELECT term, list_filter([{', '.join(f"CASE WHEN regexp_matches(md5(term)[1:{f}], '^[0-7]{{{f}}}$') THEN {f * SLOTS} + (instr('0123456789abcdef', md5(term)[{32 - f}:{32 - f}]) - 1) END" if f else f"(instr('0123456789abcdef', md5(term)[32:32]) - 1)" for f in range(FAMILIES))}], lambda z: z IS NOT NULL) AS slots FROM band),
f AS (SELECT r, ed, list(struct_pack(term := term, slots := list_transform(slots, lambda q: CAST(q AS INTEGER))) ORDER BY term) AS fs FROM t JOIN lx USING (term) GROUP BY r, ed),
g AS (SELECT s.r, s.ed, CASE WHEN fs IS NULL THEN repeat(md5(array_to_string(ts, ' '))[1:8], {SLOTS * FAMILIES}) ELSE {_SIG.replace("F,", "fs,")} END AS fp FROM s LEFT JOIN f ON s.r = f.r AND s.ed = f.ed)
SELECT e.doc_id, CAST(len(e.text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
  {_near_sql("a.fp", "b.fp")} AS near_edited, {_near_sql("a.fp", "c.fp")} AS near_next
FROM e JOIN g a ON a.r = e.r AND a.ed = 0 JOIN g b ON b.r = e.r AND b.ed = 1 JOIN g c ON c.r = e.next_r AND c.ed = 0
"""
