"""Operator 2: licence scan by canonical digests.

A text is put in canonical form (lower case, no copyright lines, punctuation as one space, equivalent
spellings unified) and its SHA-256 is joined to the digests of known licences: first the entire text
(with its title or without), then each of its lines for the one-line notices. DataFrame operations only; the known digests are a
small table whose size is counted before it is broadcast, and texts aren't shuffled.

Defined cases: a null, empty or all-punctuation text has no words, hence the digest of no bytes, and
matches nothing; repeated rows and rows of equal id are scanned row by row; a very long text is scanned whole,
but only its digests are shuffled; an empty table gives no rows; other columns never take part, whatever their
names; a text that two known licences share counts for the smaller name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._license_texts import DIGESTS, NOTICE_FORMS, NOTICE_NAMES, TEXTS, TITLES
from ._spark import small

#: A notice names a year, a sign, a form field or all rights; the licences' own sentences that begin a line so stay.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[^a-z0-9\n]*(\(c\)|©|[0-9]{4}|[\[<{])|\(c\)[^a-z0-9\n]*(copyright|[0-9]{4})|©|all rights reserved)[^\n]*$"
EQUIVALENT = (("licence", "license"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("favour", "favor"), ("fulfil ", "fulfill "), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("https ", "http "))
MAX_BROADCAST_ROWS = 100_000


def canonical(text: Column) -> Column:
    """Canonical words, with one space between them and line ends kept."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None, digests: dict[str, str] | None = None) -> DataFrame:
    """(digest, license_id, whole): of licence texts with and without their titles, and of one-line notices.

    `digests` are canonical digests of entire texts that this package doesn't carry (see digests_of_files).
    """
    digests = DIGESTS if digests is None and texts is None else digests or {}
    titles = TITLES if texts is None else {}
    texts = TEXTS if texts is None else texts
    notices = {k: [f.format(n) for n in names for f in NOTICE_FORMS] for k, names in NOTICE_NAMES.items()} if notices is None else notices
    rows = [(k, t, True) for k, t in texts.items()] + [(k, f"{title}\n{t}", True) for k, t in texts.items() for title in titles.get(k, ())]
    rows += [(k, t, False) for k, ts in notices.items() for t in ts]
    listed = F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("t"), F.lit(w).alias("whole")) for k, t, w in rows))
    table = spark.range(1).select(F.inline(listed)).select("license_id", F.sha2(one_line(canonical(F.col("t"))), 256).alias("digest"), "whole")
    if digests:
        stored = F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(d).alias("digest"), F.lit(True).alias("whole")) for d, k in digests.items()))
        table = table.unionByName(spark.range(1).select(F.inline(stored)))
    return table.groupBy("digest", "whole").agg(F.min("license_id").alias("license_id"))


def digests_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, digest) for known_digests: of each file under path as a whole, and up to the end of its terms."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("t"))
    parts = F.array("t", F.regexp_extract("t", r"(?s)^(.*\n[ \t]*END OF TERMS AND CONDITIONS)", 1))
    listed = files.select("file", F.explode(parts).alias("t")).where("t <> ''")
    return listed.select("file", F.sha2(one_line(canonical(F.col("t"))), 256).alias("digest")).distinct()


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: its digest, the licence that its entire text is, and the licences its lines name."""
    known = known_digests(docs.sparkSession) if known is None else known
    n = known.count()
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), canonical(F.col(text_col)).alias("c"))
    # line 0 is the entire text; of the other lines only those that match go on, so little is shuffled
    lines = F.concat(F.array(one_line(F.col("c"))), F.transform(F.split("c", "\n"), lambda x: F.trim(x)))
    listed = base.select("row", "doc_id", F.posexplode(lines).alias("line", "words")).where((F.col("line") == 0) | (F.col("words") != ""))
    digested = listed.select("row", "doc_id", (F.col("line") == 0).alias("entire"), F.sha2("words", 256).alias("digest"))
    wanted = known.select(F.col("digest").alias("known_digest"), F.col("whole"), "license_id")
    met = digested.join(small(wanted, n, MAX_BROADCAST_ROWS), (F.col("digest") == F.col("known_digest")) & (F.col("entire") == F.col("whole")), "left")
    met = met.where(F.col("entire") | F.col("license_id").isNotNull())
    notice = F.when(~F.col("entire"), F.col("license_id"))
    out = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(F.col("entire"), F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("entire"), F.col("license_id"))).alias("license_id"),
        F.count(notice).alias("n_notice_lines"),
        F.array_join(F.array_sort(F.collect_set(notice)), ",").alias("notices"),
    )
    return out.drop("row")
