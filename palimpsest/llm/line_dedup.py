"""Cross-site boilerplate removal by the number of distinct sites a line stands on.

Native plan: HyperLogLog sketches of sites per line hash, merged by aggregation,
settle almost every line; only lines whose estimate is near the threshold get an
exact distinct count.  Lines found on enough sites are cut from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import drop, park, small, unused

#: A line on this many distinct sites is boilerplate.
MIN_SITES = 8
#: Shorter lines carry too little to tell boilerplate from coincidence.
MIN_CHARS = 12
#: 2^LG_K sketch registers: a relative standard error of 1.04 / 64 = 1.6 %.
LG_K = 12
#: Estimates within this share of the threshold, 12 standard errors and more, are counted exactly.
BAND = 0.2


def _lines(rows: DataFrame, keys: tuple[str, str], text: str, site: str, min_chars: int) -> DataFrame:
    line = rows.select(F.col(keys[0]).alias("k1"), F.col(keys[1]).alias("k2"), F.col(f"`{site}`").cast("string").alias("site"), F.posexplode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("pos", "line"))
    key = F.expr(r"trim(BOTH ' \t\r' FROM line)")
    return line.where(F.length(key) >= min_chars).select("k1", "k2", "site", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def _without(text: Column, cut: Column) -> Column:
    """text without the lines at the positions in cut: the stretches between them, so the work grows with the lines alone."""
    lines = F.split(text, "\n", -1)
    ends = F.concat(F.array(F.lit(-1)), F.array_sort(cut), F.array(F.size(lines)))
    both = F.array(F.struct(lines.alias("lines"), ends.alias("ends")))  # worked out once: a lambda would do it again at each step

    def joined(b: Column) -> Column:
        between = lambda j: F.slice(b["lines"], b["ends"][j - 1] + 2, b["ends"][j] - b["ends"][j - 1] - 1)
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(b["ends"]) - 1), between)), "\n")

    return F.get(F.transform(both, joined), F.lit(0))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """Line hashes (h1, h2) of the rows (h1, h2, site) with min_sites distinct sites or more; null sites don't count.

    The answer is exact: sketches decide only lines whose estimate is off the
    threshold by more than band.
    """
    keys = ["h1", "h2"]
    sites = F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites")
    seen = park(lines.groupBy(*keys).agg(sites).where(F.col("sites") >= int(min_sites * (1 - band))), "sketched")
    top = int(min_sites * (1 + band)) + 1
    near = seen.where(F.col("sites") <= top).select(*keys)
    near = park(near, "near")
    exact = lines.select(*keys, "site").join(small(near), keys, "left_semi").groupBy(*keys).agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    out = park(seen.where(F.col("sites") > top).select(*keys).unionAll(exact.select(*keys)), "boilerplate")
    drop(seen)
    drop(near)
    return out


def remove_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with boilerplate lines cut from text, and n_removed, the lines cut.

    A line is what stands between line feeds; blanks, tabs and carriage returns at
    its ends don't count in comparison, and it must have min_chars characters
    without them.  A null text stays null, a text of nothing but boilerplate
    becomes empty; texts without boilerplate stay byte for byte.  Rows with a null
    site lose lines but vouch for none.  Repeated rows are all kept and treated
    alike.  An empty table stays empty; a column named n_removed is replaced, all
    others stay whatever their names.  min_chars 1 counts every line.
    """
    docs = docs.drop("n_removed")
    k1, k2, cut = (unused(docs, c) for c in ("k1", "k2", "cut"))
    own = F.col(f"`{text}`")
    cols = [F.col(f"`{c}`") for c in docs.columns if c != text and docs.schema[c].dataType.simpleString()[:3] != "map"]
    # a 128-bit hash of the whole row; equal rows share it, and lose the same lines
    rows = docs.withColumns({k1: F.xxhash64(own, *cols), k2: F.xxhash64(F.lit(7), *cols, own)})
    lines = _lines(rows, (k1, k2), text, site, min_chars)
    found = boilerplate(lines, min_sites)
    gone = lines.join(small(found), ["h1", "h2"], "left_semi").groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_set("pos").alias(cut))
    out = rows.join(gone, [k1, k2], "left")
    out = out.withColumns({text: F.when(F.col(cut).isNull(), own).otherwise(_without(own, F.col(cut))), "n_removed": F.coalesce(F.size(cut), F.lit(0))})
    return out.select(*[f"`{c}`" for c in docs.columns], "n_removed")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_boilerplate(docs.select("doc_id", "text", "source")).select("doc_id", "text", "n_removed")


OP4_SQL = rf"""
WITH line AS (
  SELECT source, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS k FROM documents
), boiler AS (
  SELECT list(k) AS ks FROM (
    SELECT k FROM line WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES})
), parts AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls,
         list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(ks, trim(x, ' ' || chr(9) || chr(13))), false)) AS kept
  FROM documents, boiler
)
SELECT doc_id, CASE WHEN len(kept) = len(ls) THEN text ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(ls) - len(kept), 0) AS INTEGER) AS n_removed
FROM parts
"""
