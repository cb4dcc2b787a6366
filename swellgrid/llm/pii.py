"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Fixed patterns find protected entities (mail addresses, IP addresses, card and phone
numbers).  Over the whole corpus, the co-occurrence of terms with each entity in the
windows around it estimates how much a term reveals: PMI(entity; term) / IC(entity), which
is 1 for a term that only ever comes with the entity.  Terms at ``DISCLOSURE`` or more, seen
with the entity in ``SUPPORT`` different texts at least, are spans of their own wherever they stand.

A window holds the whole words among the ``WINDOW_CHARS`` characters on each side of an entity, so the
pairs that a text gives grow with its entities and not with their product with its words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import flag_members, materialize, quoted

#: Order of the kinds of spans that start together.
KINDS = ("email", "ip", "card", "phone", "term")
BASE_KINDS = KINDS[:4]
WINDOW_CHARS = 240
DISCLOSURE = 0.9
SUPPORT = 3
#: Deviation of the sketches of document frequencies, and the factor by which they may be wrong: six deviations.
SKETCH_ERROR, MARGIN = 0.05, 1.3
_WORD = r"[\p{L}\p{N}]+"

# Possessive forms of the plain patterns: the same leftmost matches in linear time and constant stack.
# A match can only begin where a run of its first class begins, or where the last match ended (\G).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"
_STRUCT = "struct<kind:string,start:int,end:int,value:string>"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(_BYTE_PARTS)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


#: Elements of a part of an array that is scanned on its own, and characters of a part of a text.
SCAN_PART, TEXT_PART = 64, 1024


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running sums, or maxima, of an array of non-negative ints by ``combine``, which has to be associative with 0 as its start.

    The parts are scanned on their own and their totals once more, so the work grows with the length, not its square.
    """
    zero, none = F.lit(0), F.array().cast("array<int>")

    def scan(part: Column) -> Column:
        start = F.struct(zero.alias("at"), none.alias("seen"))

        def step(acc: Column, x: Column) -> Column:
            at = combine(acc["at"], x)
            return F.struct(at.alias("at"), F.concat(acc["seen"], F.array(at)).alias("seen"))

        return F.aggregate(part, start, step, lambda acc: acc["seen"])

    def scans(array: Column) -> Column:
        return F.transform(F.sequence(zero, F.floor((F.size(array) - 1) / SCAN_PART).cast("int")), lambda k: scan(F.slice(array, k * SCAN_PART + 1, F.lit(SCAN_PART))))

    def joined(parts: Column, before: Column) -> Column:
        """The scans of parts, each after what comes before it."""
        return F.flatten(F.transform(parts, lambda part, k: F.transform(part, lambda x: combine(F.get(before, k), x))))

    def totals(parts: Column) -> Column:
        return F.transform(parts, lambda part: F.element_at(part, -1))

    def shifted(array: Column) -> Column:
        return F.concat(F.array(zero), array)

    # What comes before each part is the scan of the parts' totals, which is taken in parts for the same reason.
    upper = lambda groups: let(shifted(scan(totals(groups))), lambda before: joined(groups, before))
    whole = lambda parts: let(shifted(let(scans(totals(parts)), upper)), lambda before: joined(parts, before))
    return F.when(F.size(values) > 0, let(values, lambda v: let(scans(v), whole))).otherwise(none)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` has it within lambdas."""
    return F.transform(F.array(value), body)[0]


def text_parts(text: Column) -> Column:
    """A text in parts of ``TEXT_PART`` characters, from which ``cut_out`` takes pieces without counting from the start each time."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / TEXT_PART).cast("int")), lambda k: F.substring(text, k * TEXT_PART + 1, F.lit(TEXT_PART)))


def cut_out(parts: Column, start: Column, length: Column) -> Column:
    """``length`` characters from ``start`` (from 0) of a text in parts."""
    first = F.floor(start / TEXT_PART).cast("int")
    last = F.floor((start + length) / TEXT_PART).cast("int")
    near = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.when(length > 0, F.substring(near, start - first * TEXT_PART + 1, length)).otherwise("")


def _placed(kind: str, matches: Column, gaps: Column) -> Column:
    """Spans of the matches: each starts after the gaps and matches before it."""
    ends = running(F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(gaps, i))), lambda a, b: a + b)
    spans = F.transform(F.arrays_zip(matches.alias("value"), ends.alias("end")), lambda s: F.struct(F.lit(kind).alias("kind"), (s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return F.when(F.size(matches) > 0, F.filter(spans, lambda s: _valid(kind, s["value"]))).otherwise(F.array().cast(f"array<{_STRUCT}>"))


def ordered(spans: Column) -> Column:
    """Spans by start, then by kind as listed."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"], F.element_at(rank, s["kind"]).alias("rank"), s["end"], s["kind"], s["value"]))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"]))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, h, k): ``h`` and ``k`` are what a text is known by, however the table is split in another scan."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    return rows.withColumn("h", F.xxhash64("text")).withColumn("k", F.xxhash64(F.lit(1), "text"))


def _window(parts: Column, size: Column, start: Column, end: Column, chars: int | None) -> tuple[Column, Column]:
    """The whole words among ``chars`` characters before and after a span (None: all of the text); a word that the window's edge cuts is left out."""
    if chars is None:
        return cut_out(parts, F.lit(0), start), cut_out(parts, end, size - end)
    cut = F.greatest(start - chars, F.lit(0))
    before = cut_out(parts, cut, start - cut)
    stop = F.least(end + chars, size)
    after = cut_out(parts, end, stop - end)
    before = F.when((cut > 0) & cut_out(parts, F.greatest(cut - 1, F.lit(0)), F.lit(1)).rlike(_WORD), F.regexp_replace(before, rf"^{_WORD}", "")).otherwise(before)
    after = F.when((stop < size) & cut_out(parts, stop, F.lit(1)).rlike(_WORD), F.regexp_replace(after, rf"{_WORD}\z", "")).otherwise(after)
    return before, after


def base_spans(rows: DataFrame, window_chars: int | None = WINDOW_CHARS) -> DataFrame:
    """(id, h, k, spans, windows) of ``_rows``; ``windows`` holds the text around each span."""
    text = F.col("text")
    worth = {"email": F.contains(text, F.lit("@")), "ip": F.col("digits"), "card": F.col("digits"), "phone": F.contains(text, F.lit("+"))}
    found = [
        x
        for k, p in PATTERNS.items()
        for x in (
            F.when(worth[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"m_{k}"),
            F.when(worth[k], F.split(text, p, -1)).otherwise(F.array().cast("array<string>")).alias(f"g_{k}"),
        )
    ]
    # A generator keeps the optimiser from copying the pattern searches into the lambdas below.
    rows = rows.withColumn("digits", text.rlike("[0-9]"))
    rows = rows.select("id", "text", "h", "k", F.inline(F.array(F.struct(*found))))
    spans = ordered(F.concat(*[_placed(k, F.col(f"m_{k}"), F.col(f"g_{k}")) for k in PATTERNS]))
    parts = F.when(F.size("spans") > 0, text_parts(text))
    rows = rows.select("id", "text", "h", "k", F.inline(F.array(F.struct(spans.alias("spans")))))
    rows = rows.select("id", "h", "k", "spans", F.length("text").alias("size"), F.inline(F.array(F.struct(parts.alias("parts")))))
    around = F.transform(
        "spans", lambda s: F.struct(entity(s["kind"], s["value"]).alias("entity"), *[w.alias(n) for w, n in zip(_window(F.col("parts"), F.col("size"), s["start"], s["end"], window_chars), ("before", "after"), strict=True)])
    )
    return rows.select("id", "h", "k", "spans", F.when(F.size("spans") > 0, around).alias("windows"))


def entity(kind: Column, value: Column) -> Column:
    """One spelling of each protected value."""
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(value)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def disclosing_terms(rows: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Terms that reveal an entity (term, entity, disclosure), and the texts (h, k, term) that hold a candidate term.

    Texts, not rows, are counted, so that copies add nothing.  Entities in fewer than ``support`` texts
    can reveal nothing and go first.  The texts that hold a term near any entity are a lower bound of all
    that hold it, and so bound its disclosure from above, which rules out most common words.  Those of
    the rest that a sketch of the texts holding them rules out, by ``MARGIN``, go next; both sum
    map-side.  Only the others are then counted exactly over the corpus.
    """
    windows = found.where("windows IS NOT NULL").select("h", F.inline("windows"))
    around = F.explode(F.array_distinct(F.concat(_words(F.col("before")), _words(F.col("after"))))).alias("term")
    entities = windows.select("entity", "h").distinct().groupBy("entity").agg(F.count("*").alias("df_entity")).where(F.col("df_entity") >= support)
    entities = materialize(entities, "entities")
    near = windows.join(entities.select("entity"), "entity", "left_semi").select("h", "entity", around).distinct()
    together = materialize(near.groupBy("entity", "term").agg(F.count("*").alias("df_both")).where(F.col("df_both") >= support), "together")
    seen = windows.select("h", around).join(together.select("term").distinct(), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("df_near"))
    texts = found.select("h").distinct().agg(F.count("*").alias("texts"))
    n = F.col("texts").cast("double")

    def disclosed(df_term: Column) -> Column:
        pmi = F.log(F.col("df_both") * n / (F.col("df_entity") * df_term))
        return F.try_divide(pmi, F.log(n / F.col("df_entity")))

    words = rows.select("h", "k", F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    pairs = together.join(entities, "entity").join(seen, "term").crossJoin(F.broadcast(texts))
    pairs = materialize(pairs.where(disclosed(F.col("df_near")) >= disclosure), "candidates")
    sketched = words.join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.approx_count_distinct("h", SKETCH_ERROR).alias("df_about"))
    pairs = pairs.join(sketched, "term").where(disclosed(F.greatest(F.col("df_about") / MARGIN, F.lit(1.0))) >= disclosure)
    pairs = materialize(pairs, "rare-candidates")
    holding = materialize(words.join(pairs.select("term").distinct(), "term", "left_semi").distinct(), "holding")
    frequency = holding.groupBy("term").agg(F.count("*").alias("df_term"))
    scored = pairs.join(frequency, "term").withColumn("disclosure", disclosed(F.col("df_term"))).where(F.col("disclosure") >= disclosure)
    return materialize(scored.select("term", "entity", "disclosure"), "terms"), holding


def term_spans(rows: DataFrame, terms: DataFrame, holding: DataFrame) -> DataFrame:
    """(h, k, more): the spans of ``terms`` in each of the texts ``holding`` one."""
    held = holding.join(terms.select("term").distinct(), "term", "left_semi")
    flagged = materialize(held.groupBy("h", "k").agg(F.collect_set("term").alias("terms")), "flagged")
    marked = flag_members(rows.select("h", "k", "text"), F.struct("h", "k"), flagged, F.struct("h", "k"), "flag").where("flag")
    # Of equal texts one is enough.
    texts = marked.groupBy("h", "k").agg(F.first("text").alias("text")).join(flagged, ["h", "k"])
    texts = texts.select("h", "k", "terms", F.split("text", _WORD, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("words"))
    words = texts.select("h", "k", "terms", F.posexplode(F.arrays_zip(F.col("gaps").alias("gap"), F.col("words").alias("word"))))
    words = words.select("h", "k", "terms", "pos", F.col("col.gap").alias("gap"), F.coalesce("col.word", F.lit("")).alias("word"))
    end = F.sum(F.length("gap") + F.length("word")).over(Window.partitionBy("h", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hits = words.withColumn("end", end.cast("int")).where(F.array_contains("terms", F.lower("word")))
    span = F.struct(F.lit("term").alias("kind"), (F.col("end") - F.length("word")).alias("start"), "end", F.col("word").alias("value"))
    return materialize(hits.groupBy("h", "k").agg(F.collect_list(span).alias("more")), "term-spans")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT, window_chars: int | None = WINDOW_CHARS) -> DataFrame:
    """``id_col`` and ``spans`` (kind, start, end in code points with the end exclusive, value) of every row.

    A term counts as near an entity within ``window_chars`` characters of it, or anywhere in its text with None, which
    pairs every entity of a text with every word of it.  Common words are ruled out by sketches first: a term
    is lost if its sketch is wrong by a factor over ``MARGIN``, six of its deviations.

    Spans are ordered by start and kind.  Null and empty texts have none; rows that repeat
    an id, or have a null one, each give a row; an empty table gives no rows; other columns
    are left out.
    """
    rows = _rows(docs, id_col, text_col)
    found = materialize(base_spans(rows, window_chars), "pii")
    terms, holding = disclosing_terms(rows, found, disclosure, support)
    out = found.join(term_spans(rows, terms, holding), ["h", "k"], "left")
    spans = F.when(F.col("more").isNull(), F.col("spans")).otherwise(ordered(F.concat("spans", F.coalesce("more", F.array().cast(f"array<{_STRUCT}>")))))
    return out.select(F.col("id").alias(id_col), spans.alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each base span generalised to its kind in brackets and each disclosing term removed; of spans that overlap the first counts."""
    mark = lambda s: F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def pieces(parts: Column, reached: Column) -> Column:
        keyed = F.transform(spans, lambda s, i: F.struct(F.coalesce(F.get(reached, i - 1), F.lit(0)).alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))
        # Of what overlaps an earlier span nothing is left: where it ends is in the next one's ``at``.
        apart = F.filter(keyed, lambda s: s["start"] >= s["at"])
        kept = F.array_join(F.transform(apart, lambda s: F.concat(cut_out(parts, s["at"], s["start"] - s["at"]), mark(s))), "")
        last = F.element_at(reached, -1)
        return F.concat(kept, cut_out(parts, last, F.length(text) - last))

    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return F.when(F.size(spans) > 0, let(text_parts(text), lambda parts: let(ends, lambda reached: pieces(parts, reached)))).otherwise(text)


def sanitise_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, text, n_spans) of every row with the spans of ``find_pii`` generalised or removed; a null text is empty.

    Texts are rewritten where they are read again; spans come to them by the text's digests, one row for each distinct text.
    """
    rows = _rows(docs, id_col, text_col)
    spans = find_pii(rows.select(F.struct("h", "k").alias("key"), "text"), "key", **options).where(F.size("spans") > 0)
    spans = materialize(spans.groupBy("key").agg(F.first("spans").alias("spans")), "text-spans")
    out = rows.withColumn("key", F.struct("h", "k")).join(spans, "key", "left")
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(sanitised(F.col("text"), F.col("spans")))
    return out.select(F.col("id").alias(id_col), clean.alias(text_col), F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"))
