"""Exact de-duplication by progressive refinement: length, prefix digest, full digest.

Two scans.  The first gives each text's length and the digest of its prefix; groups of
one are settled there.  The keys of the groups that survive go into a bitmap sized by their
number, and the second scan computes the full digest only where the bitmap hits.  Rows of
one group are only ever summed map-side first and joined, so a group that holds a
third of all rows is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, flag_members, materialize, quoted

#: Characters of the normalised text that the second level reads.
PREFIX_CHARS = 64


def with_normalised(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add ``out``: null as empty, each run of blanks and line breaks as one space.

    Plain searches tell the texts that need the pattern; the others only have line feeds
    replaced, at a tenth of its cost.
    """
    df = df.withColumn(out, F.coalesce(F.col(text_col), F.lit("")))
    flat = F.replace(F.col(out), F.lit("\n"), F.lit(" "))
    odd = F.contains(flat, F.lit("  "))
    for code in (0x09, 0x0B, 0x0C, 0x0D):
        odd = odd | F.contains(F.col(out), F.lit(chr(code)))
    return df.withColumn(out, F.when(odd, F.regexp_replace(out, r"[\x20\x09-\x0D]+", " ")).otherwise(flat))


def _surviving(df: DataFrame, text_col: str, prefix_chars: int) -> DataFrame:
    """(n, p): length and prefix digest of the texts that are not alone with them."""
    level1 = with_normalised(df.select(F.col(quoted(text_col)).alias("t")), "t", "t").select(
        F.length("t").cast("bigint").alias("n"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("p")
    )
    return materialize(level1.groupBy("n", "p").agg(F.count("*").alias("c")).where("c > 1").select("n", "p"), "surviving")


def _levels(df: DataFrame, text: Column, prefix_chars: int, surviving: DataFrame) -> DataFrame:
    """Add ``t`` (normalised text), ``n``, ``p`` and ``hit``: whether the text may have copies."""
    rows = with_normalised(df.withColumn("t", text), "t", "t")
    rows = rows.withColumn("n", F.length("t").cast("bigint")).withColumn("p", F.xxhash64(F.substring("t", 1, prefix_chars)))
    return flag_members(rows, F.struct("n", "p"), surviving, F.struct("n", "p"), "hit")


def _content(df: DataFrame, columns: list[Column] | None = None) -> list[Column]:
    """Two digests of all columns of a row.  Of rows with one id they decide, since row numbers of two scans can differ."""
    columns = columns or [F.col(quoted(c)) for c in df.columns]
    cells = [c.cast("string") if "map<" in f.dataType.simpleString() else c for c, f in zip(columns, df.schema, strict=True)]
    return [F.xxhash64(*cells).alias("one"), F.xxhash64(F.lit(1), *cells).alias("two")]


def _groups(rows: DataFrame, order: Column) -> DataFrame:
    """(n, p, full, first, equal, size) of each group of copies; ``equal`` counts the rows that are all the first."""
    counted = rows.groupBy("n", "p", "full", order.alias("order")).agg(F.count("*").alias("c"))
    groups = counted.groupBy("n", "p", "full").agg(F.min(F.struct("order", "c")).alias("least"), F.sum("c").alias("size")).where("size > 1")
    # A table of its own: both sides of the join that follows can be split.
    return materialize(groups.select("n", "p", "full", F.col("least.order").alias("first"), F.col("least.c").alias("equal"), "size"), "copies")


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: str | None = None,
    prefix_chars: int = PREFIX_CHARS,
) -> DataFrame:
    """All rows and columns of ``df`` plus ``keep_id``, ``group_size`` (long) and ``kept``.

    Of equal normalised texts the row with the smallest id stays (a null id counts as the
    largest; of repeated rows with that id one stays).  Null text equals empty text.  An
    empty table gives an empty result.  Columns of ``df`` with those names are replaced.
    ``digest`` names a column for every row's SHA-256, which then is computed for all rows;
    the text itself is left out then, and the other columns are written to a scratch table.
    """
    df = df.drop("keep_id", "group_size", "kept", *([digest] if digest else []))
    surviving = _surviving(df, text_col, prefix_chars)
    src = [F.col(quoted(c)).alias(f"src_{i}") for i, c in enumerate(df.columns) if c != text_col or digest is None]
    # With a digest the rows are written once, and so are their numbers.
    at = F.monotonically_increasing_id() if digest else F.struct(*_content(df))
    rows = _levels(df.select(*src, F.col(quoted(text_col)).alias("text_"), F.col(quoted(id_col)).alias("id"), at.alias("at")), F.col("text_"), prefix_chars, surviving)
    rows = rows.select(
        *[f"src_{i}" for i, c in enumerate(df.columns) if c != text_col or digest is None],
        *([F.sha2(F.col("t").cast("binary"), 256).alias("d")] if digest else []),
        F.when(F.col("hit"), F.sha2(F.col("t").cast("binary"), 256)).alias("full"),
        "n", "p", "id", "at",
    )
    if digest:  # without the text the rows are small: keep them rather than scan the texts a third time
        rows = materialize(rows, "exact-dedup")
    maybe = rows.where(F.col("full").isNotNull())
    groups = _groups(maybe, F.struct(F.col("id").isNull().alias("no_id"), "id", "at"))
    names = [c for c in df.columns if c != text_col or digest is None]
    # Rows that the bitmap settles stay where they are; only the others are dealt by key.
    alone = rows.where(F.col("full").isNull()).withColumns({c: F.lit(None).cast(groups.schema[c].dataType) for c in ("first", "equal", "size")})
    out = alone.unionByName(maybe.join(groups, ["n", "p", "full"], "left"))
    first = F.coalesce(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("at") == F.col("first.at")), F.lit(False))
    out = out.withColumn("kept_", F.col("size").isNull() | first)
    if digest is None and groups.where("equal > 1").head(1):  # equal rows: one of them stays
        again = F.col("kept_") & (F.coalesce("equal", F.lit(1)) > 1)
        copies = out.where(again).groupBy("n", "p", "full").agg(F.first(F.struct(*out.columns)).alias("r"))
        copies = copies.select("r", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("r.equal"))).alias("nth"))
        copies = copies.select(*[F.col(f"r.{c}").alias(c) for c in out.columns if c != "kept_"], (F.col("nth") == 1).alias("kept_"))
        out = out.where(~again).unionByName(copies)
    return out.select(
        *[F.col(f"src_{i}").alias(c) for i, c in enumerate(df.columns) if c in names],
        *([F.col("d").alias(digest)] if digest else []),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("kept_").alias("kept"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of ``df`` that ``exact_dedup`` keeps, with their columns.

    Only rows that may have copies give keys to a shuffle, and only rows that a bitmap of the
    dropped ids marks are joined; all others pass where they are.  Ties, nulls, repeated rows and empty tables as there.
    """
    surviving = _surviving(df, text_col, prefix_chars)
    light = _levels(df.select(F.col(quoted(text_col)).alias("text_"), F.col(quoted(id_col)).alias("id"), *_content(df)), F.col("text_"), prefix_chars, surviving).where("hit")
    light = materialize(light.select("n", "p", F.sha2(F.col("t").cast("binary"), 256).alias("full"), "id", "one", "two"), "maybe-copies")
    groups = _groups(light, F.struct(F.col("id").isNull().alias("no_id"), "id", F.struct("one", "two").alias("at")))
    grouped = light.join(groups, ["n", "p", "full"])
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("one") == F.col("first.at.one")) & (F.col("two") == F.col("first.at.two"))
    # The first row stays unless it comes several times; then one of them does.
    gone = grouped.withColumn("again", is_first).where("NOT again OR equal > 1").select(F.col("id").alias("gone_id"), F.col("one").alias("gone_one"), F.col("two").alias("gone_two"), "again").distinct()
    gone = materialize(gone, "gone")
    discard(surviving, light, groups)
    id_text = F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))
    columns = [quoted(c) for c in df.columns]
    named = df.select(*[F.col(c).alias(f"src_{i}") for i, c in enumerate(columns)], id_text.alias("key"))
    flagged = flag_members(named, F.col("key"), gone, F.coalesce(F.col("gone_id").cast("string"), F.lit("")), "flag")
    src = [F.col(f"src_{i}") for i in range(len(columns))]
    hit = flagged.where("flag").select(*src, "key", *_content(df, src))
    on = (F.col("key") == F.coalesce(F.col("gone_id").cast("string"), F.lit(""))) & (F.col("one") == F.col("gone_one")) & (F.col("two") == F.col("gone_two"))
    out = flagged.where("NOT flag").select(*src).unionByName(hit.join(gone, on, "left_anti").select(*src))
    if gone.where("again").head(1):
        once = hit.join(gone.where("again"), on, "left_semi").groupBy("key", "one", "two").agg(F.first(F.struct(*src)).alias("r"))
        out = out.unionByName(once.select(*[F.col(f"r.src_{i}") for i in range(len(columns))]))
    return out.select(*[c.alias(name) for c, name in zip(src, df.columns, strict=True)])
