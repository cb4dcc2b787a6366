"""Registered queries of the subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import ABSORBED, MAX_WORDS, MIN_COUNT, TOP, find_collocations
from .collocations import SCALE as SCORE_SCALE
from .decontamination import WINDOW, find_contamination
from .divergence import MIN_DOCS, PRIOR, SCALE, TOP_TERMS, source_divergence
from .embedding_dedup import near_vectors
from .exact_dedup import exact_dedup
from .licenses import LICENSES, SPELLINGS, scan_licenses
from .mixing import mix_sources
from .near_dup import near_dup_classes
from .packing import pack_documents
from .pii import BASE_KINDS as PII_KINDS
from .pii import DISCLOSURE, SUPPORT, WINDOW_CHARS, find_pii
from .quality import quality_selection
from .secrets import BASE_KINDS, count_of, joined, scan_secrets
from .url_filter import ALPHABET, ORDER, RULES, judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Which domain each source belongs to, and the target weights of the mix.
DOMAINS = {
    "web": ["src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7"],
    "books": ["src8", "src9", "src10", "src11", "src12", "src13"],
    "news": ["src14", "src15", "src16", "src17"],
    "code": ["src18", "src19"],
}
MIX_WEIGHTS: dict[str, dict[str, float]] = {
    "domain": {"web": 40, "books": 30, "news": 20, "code": 10},
    "lang": {"en": 60, "de": 15, "fr": 15, "es": 10},
}


def mix_levels(source: str = "source", lang: str = "lang") -> dict[str, Column]:
    domain = F.lit("other")
    for name, sources in DOMAINS.items():
        domain = F.when(F.col(source).isin(sources), F.lit(name)).otherwise(domain)
    return {"domain": domain, "lang": F.col(lang), "source": F.col(source)}


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS)
    return mixed.select("doc_id", "domain", "lang", "source", "epoch")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[count_of(spans, k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(spans, BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[count_of(spans, k).alias(f"n_{k}") for k in PII_KINDS],
        F.sha2(joined(spans, PII_KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = exact_dedup(docs, digest="text_sha256")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_selection(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.col("selected").alias("kept"), "log_weight", "sample_key")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_classes(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 9).alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_collocations(_table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("bigint"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
    )


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_mixing": op2_mixing,
    "op3_secrets": op3_secrets,
    "op4_pii": op4_pii,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_licenses": op8_licenses,
    "op9_minhash_near_dup": op9_minhash_near_dup,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_decontamination": op12_decontamination,
    "op13_source_divergence": op13_source_divergence,
}

_DOMAIN_SQL = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in DOMAINS.items()) + " ELSE 'other' END"
_DOMAIN_WEIGHT_SQL = "CASE domain " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS["domain"].items()) + " ELSE 1 END"
_LANG_WEIGHT_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS["lang"].items()) + " ELSE 1 END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LICENSES_SQL = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in LICENSES)
_SPELLINGS_SQL = "lower(t)"
for _old, _new in SPELLINGS:
    _SPELLINGS_SQL = f"replace({_SPELLINGS_SQL}, {_quoted(_old)}, {_quoted(_new)})"


def _level_sql(name: str, parent: str, column: str, weight: str, given: str) -> str:
    """One level of the water-filling: quotas of ``column`` within ``parent``."""
    on = " AND ".join(f"n.{c} IS NOT DISTINCT FROM g.{c}" for c in parent.split(", ")) if parent else "true"
    part = f"PARTITION BY {', '.join('n.' + c for c in parent.split(', '))}" if parent else ""
    over = part.replace("n.", "")
    keys = f"{parent}, {column}" if parent else column
    return f"""
        {name}_n AS (SELECT {keys}, sum(cap) AS cap, CAST({weight} AS DOUBLE) AS weight FROM caps GROUP BY {keys}),
        {name}_l AS (
            SELECT n.*, (g.budget - coalesce(sum(n.cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                        / sum(n.weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM {name}_n n JOIN {given} g ON {on}
            WINDOW w AS ({part} ORDER BY n.cap / n.weight, n.{column} NULLS FIRST)
        ),
        {name} AS (
            SELECT {keys}, greatest(0.0, least(cap, max(level) OVER ({over}) * weight)) AS budget FROM {name}_l
        )"""


def _grams_sql() -> str:
    """Witten-Bell probabilities of each n-gram, one table an order; ``p5`` has those of the highest."""
    out = []
    for k in range(ORDER + 1):
        of = f"c{k}" if k else "counts"
        before = {m: f"p.p{m}" if k else f"{1 / ALPHABET}::DOUBLE" for m in "ar"}
        prob = ", ".join(f"CASE WHEN h{m} > 0 THEN (c{m} + t{m} * {before[m]}) / (h{m} + t{m}) ELSE {before[m]} END AS p{m}" for m in "ar")
        out.append(f"""
        s{k} AS (SELECT g[{ORDER + 1 - k}:] AS s, g[{ORDER + 1 - k}:{ORDER}] AS h, sum(na)::BIGINT AS ca, sum(nr)::BIGINT AS cr FROM counts GROUP BY ALL),
        h{k} AS (SELECT h, sum(ca)::BIGINT AS ha, sum(cr)::BIGINT AS hr, count(*) FILTER (ca > 0) AS ta, count(*) FILTER (cr > 0) AS tr FROM s{k} GROUP BY h),
        c{k + 1} AS (SELECT p.g, {prob} FROM {of} p JOIN s{k} ON g[{ORDER + 1 - k}:] = s JOIN h{k} USING (h))""")
    return ",".join(out)


_UPPER_SQL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_RULE_SQL = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN ['{h}{p}', '{v}']" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
) + " END"

#: Kind, pattern and what a match has to be, for ``m`` the match and ``d`` its digits.
_PII_SQL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: x::DOUBLE > 255)) = 0"),
    (
        "card",
        r"[0-9]([\x20-]?[0-9])+",
        "length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: list_sum(list_transform("
        "string_split((d[length(d) - i + 1]::INT * (2 - i % 2))::VARCHAR, ''), lambda x: x::INT)))) % 10 = 0",
    ),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
)


def _placed_sql(texts: str, pattern: str) -> str:
    """(r, m, s, e): the matches of a pattern in the texts (r, t), from the lengths of what lies between and before."""
    return f"""
        SELECT r, m, e - length(m) AS s, e FROM (
            SELECT r, m, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i)::BIGINT AS e FROM (
                SELECT r, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, unnest(range(len(ms))) AS i
                FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gaps FROM {texts})
            )
        )"""


_WORD_SQL = r"[\p{L}\p{N}]+"
_PII_SPANS_SQL = " UNION ALL ".join(
    f"SELECT r, '{kind}' AS kind, {rank} AS rank, s, e, CASE WHEN {rank} < 2 THEN lower(m) ELSE d END AS value "
    f"FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM ({_placed_sql('docs', pattern)})) WHERE {valid}"
    for rank, (kind, pattern, valid) in enumerate(_PII_SQL)
)

_PLAIN_WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SHARE_SQL = f"CAST(1 + ({SCALE}::HUGEINT * ({{n}} + {PRIOR})) // nullif({{total}} + {PRIOR} * {{terms}}, 0) AS BIGINT)"

ORACLE: dict[str, str] = {
    "op11_collocations": rf"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_UPPER_SQL}), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
        listed AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
        runs AS ({" UNION ALL ".join(f"SELECT lang, {k} AS size, unnest(list_transform(range(1, greatest(len(ws) - {k} + 2, 1)), lambda i: ws[i:i + {k - 1}])) AS words FROM listed" for k in range(1, MAX_WORDS + 1))}),
        grams AS MATERIALIZED (SELECT lang, size, array_to_string(words, ' ') AS phrase, words, count(*) AS f FROM runs GROUP BY ALL),
        totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM listed GROUP BY lang),
        candidates AS MATERIALIZED (SELECT * FROM grams WHERE size > 1 AND f >= {MIN_COUNT}),
        cuts AS MATERIALIZED (SELECT lang, phrase, size, f AS a, k, array_to_string(words[:k], ' ') AS lp, array_to_string(words[k + 1:], ' ') AS rp FROM candidates, unnest(range(1, size)) AS places(k)),
        parts AS MATERIALIZED (SELECT lang, phrase, f FROM grams WHERE size < {MAX_WORDS} AND f >= {MIN_COUNT}),
        lefts AS MATERIALIZED (SELECT c.*, x.f AS l FROM cuts c JOIN parts x ON x.lang = c.lang AND x.phrase = c.lp),
        scored AS MATERIALIZED (SELECT c.*, x.f AS r, ({SCORE_SCALE}::HUGEINT * a * a) // (l::HUGEINT * x.f) AS score FROM lefts c JOIN parts x ON x.lang = c.lang AND x.phrase = c.rp),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_phrases AS (SELECT lang, array_to_string(words[i:i + s - 1], ' ') AS phrase, max(f) AS f FROM candidates, unnest(range(2, size)) AS shorter(s), unnest(range(1, size - s + 2)) AS places(i) GROUP BY ALL)
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score::BIGINT AS score
        FROM best b JOIN totals USING (lang) LEFT JOIN inner_phrases i ON i.lang = b.lang AND i.phrase = b.phrase
        WHERE i.f IS NULL OR 100 * i.f < {ABSORBED} * a QUALIFY rank <= {TOP}
    """,
    "op12_decontamination": rf"""
        WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER_SQL}), '{_PLAIN_WORD_SQL}') AS ws FROM documents),
        items AS MATERIALIZED (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER_SQL}), '{_PLAIN_WORD_SQL}') AS ws FROM benchmark),
        windows AS MATERIALIZED (
            SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS size, array_to_string(ws[i:i + {WINDOW} - 1], ' ') AS phrase
            FROM items, unnest(range(1, greatest(len(ws) - {WINDOW} + 2, 2))) AS places(i) WHERE len(ws) > 0
        ),
        sizes AS (SELECT DISTINCT size FROM windows),
        places AS (SELECT r, i, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM docs, sizes, unnest(range(1, greatest(len(ws) - size + 2, 1))) AS places(i)),
        hits AS MATERIALIZED (SELECT r, i, size, phrase FROM places SEMI JOIN windows USING (size, phrase)),
        covered AS (SELECT DISTINCT r, w FROM hits, unnest(range(i, i + size)) AS words(w)),
        counted AS (SELECT r, count(*) AS n_hit FROM covered GROUP BY r),
        starts AS (SELECT r, w - 1 AS w, row_number() OVER (PARTITION BY r ORDER BY w) AS k FROM covered),
        islands AS (SELECT r, min(w) AS a, max(w) + 1 AS b FROM starts GROUP BY r, w - k),
        listed AS (SELECT r, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM islands GROUP BY r),
        named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, size, phrase FROM hits) JOIN windows USING (size, phrase) GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN counted USING (r) LEFT JOIN listed USING (r) LEFT JOIN named USING (r)
    """,
    "op13_source_divergence": rf"""
        WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {_UPPER_SQL}) AS t FROM documents),
        occurrences AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS MATERIALIZED (SELECT lang, term FROM occurrences GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
        counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM occurrences SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        stats AS MATERIALIZED (
            SELECT lang, source, coalesce(total, 0) AS total, coalesce(terms, 0) AS terms FROM groups
            LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS total FROM counts GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS terms FROM kept GROUP BY lang) USING (lang)
        ),
        shares AS MATERIALIZED (
            SELECT lang, source, term, coalesce(n, 0) AS n, {_SHARE_SQL.format(n="coalesce(n, 0)", total="total", terms="terms")} AS p
            FROM stats JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
        ),
        langs AS (SELECT lang, any_value(terms) AS terms, sum(total)::BIGINT AS total FROM stats GROUP BY lang),
        overall AS (SELECT lang, term, {_SHARE_SQL.format(n="sum(n)::BIGINT", total="any_value(total)", terms="any_value(terms)")} AS q FROM counts JOIN langs USING (lang) GROUP BY lang, term),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        rows AS (
            SELECT lang, source, 'pair' AS part, item, value FROM pairs
            UNION ALL SELECT lang, source, 'term', term, p - q FROM shares JOIN overall USING (lang, term) WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows
        QUALIFY part = 'pair' OR rank <= {TOP_TERMS}
    """,
    "op4_pii": f"""
        WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        base AS MATERIALIZED ({_PII_SPANS_SQL}),
        edges AS (SELECT t, kind || ':' || value AS entity, s, e, greatest(s - {WINDOW_CHARS}, 0) AS cut FROM base JOIN docs USING (r)),
        windows AS MATERIALIZED (
            SELECT t, entity,
                   CASE WHEN cut > 0 AND regexp_matches(t[cut:cut], '{_WORD_SQL}') THEN regexp_replace(t[cut + 1:s], '^{_WORD_SQL}', '') ELSE substring(t, cut + 1, s - cut) END AS before,
                   CASE WHEN regexp_matches(substring(t, e + {WINDOW_CHARS} + 1, 1), '{_WORD_SQL}') THEN regexp_replace(substring(t, e + 1, {WINDOW_CHARS}), '{_WORD_SQL}\\z', '')
                        ELSE substring(t, e + 1, {WINDOW_CHARS}) END AS after
            FROM edges
        ),
        entities AS (SELECT entity, count(DISTINCT t) AS df_entity FROM windows GROUP BY entity HAVING df_entity >= {SUPPORT}),
        near AS (SELECT DISTINCT t, entity, unnest(regexp_extract_all(lower(before), '{_WORD_SQL}') || regexp_extract_all(lower(after), '{_WORD_SQL}')) AS term FROM windows SEMI JOIN entities USING (entity)),
        together AS MATERIALIZED (SELECT entity, term, count(*) AS df_both FROM near GROUP BY ALL HAVING df_both >= {SUPPORT}),
        texts AS (SELECT DISTINCT t FROM docs),
        held AS (SELECT DISTINCT t, unnest(regexp_extract_all(lower(t), '{_WORD_SQL}')) AS term FROM texts),
        frequency AS (SELECT term, count(*) AS df_term FROM held SEMI JOIN together USING (term) GROUP BY term),
        terms AS MATERIALIZED (
            SELECT DISTINCT term FROM together JOIN entities USING (entity) JOIN frequency USING (term), (SELECT count(*)::DOUBLE AS n FROM texts)
            WHERE ln(df_both * n / (df_entity * df_term)) / nullif(ln(n / df_entity), 0) >= {DISCLOSURE}::DOUBLE
        ),
        words AS ({_placed_sql("docs", _WORD_SQL)}),
        spans AS (
            SELECT r, kind, rank, s, e FROM base
            UNION ALL SELECT r, 'term', {len(_PII_SQL)}, s, e FROM words SEMI JOIN terms ON lower(m) = term
        ),
        listed AS (
            SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in _PII_SQL)},
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'term') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
            FROM spans GROUP BY r
        )
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, _, _ in _PII_SQL)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN listed USING (r)
    """,
    "op10_url_filter": f"""
        WITH parts AS (SELECT page_id, translate(coalesce(url, ''), {_UPPER_SQL}) AS u, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        hosts AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), {_UPPER_SQL}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
        base AS (SELECT *, {_RULE_SQL} AS fits FROM hosts),
        urls AS (SELECT u, min(fits[2]) AS verdict, md5(u)[1] < '8' AS train FROM base GROUP BY u),
        grams AS MATERIALIZED (SELECT u, verdict, train, substring(repeat(chr(2), {ORDER}) || u, i, {ORDER + 1}) AS g FROM urls, unnest(range(1, length(u) + 1)) AS places(i)),
        counts AS MATERIALIZED (SELECT g, count(*) FILTER (train AND verdict = 'allow') AS na, count(*) FILTER (train AND verdict = 'block') AS nr FROM grams GROUP BY g),
        {_grams_sql()},
        scores AS MATERIALIZED (SELECT u, coalesce(avg(ln(pa) - ln(pr)), 0) AS score FROM urls LEFT JOIN grams USING (u) LEFT JOIN c{ORDER + 1} USING (g) GROUP BY u),
        known AS (SELECT score, verdict FROM scores JOIN urls USING (u) WHERE NOT train AND verdict IS NOT NULL AND u <> ''),
        spread AS (SELECT min(score) AS lo, max(score) AS hi, count(DISTINCT verdict) AS kinds, count(*) FILTER (verdict = 'allow') AS allowed, count(*) FILTER (verdict = 'block') AS blocked FROM known),
        bins AS (
            SELECT least(floor((score - lo) / nullif((hi - lo) / 2000, 0)), 1999) AS slot, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM known, spread GROUP BY slot
        ),
        gains AS (SELECT slot, sum(a) OVER w / allowed - sum(b) OVER w / blocked AS gain FROM bins, spread WINDOW w AS (ORDER BY slot DESC)),
        cuts AS (SELECT CASE WHEN kinds < 2 OR lo = hi THEN '-infinity'::DOUBLE ELSE lo + (SELECT min(slot) FROM gains WHERE gain = (SELECT max(gain) FROM gains)) * (hi - lo) / 2000 END AS cut FROM spread)
        SELECT page_id, host, path, fits[1] AS rule, coalesce(fits[2], CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict, round(score, 9) AS score
        FROM base JOIN scores USING (u), cuts
    """,
    "op1_embedding_dedup": """
        WITH RECURSIVE fine AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.9::DOUBLE
        ),
        reach AS (SELECT a AS id, b AS seen FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.seen),
        counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
        lowest AS (SELECT id AS vec_id, min(seen) AS low FROM reach GROUP BY id)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id,
               e.vec_id <= coalesce(low, e.vec_id) AS kept
        FROM embeddings e LEFT JOIN counted USING (vec_id) LEFT JOIN lowest USING (vec_id)
    """,
    "op2_mixing": rf"""
        WITH words AS (
            SELECT doc_id, lang, source, {_DOMAIN_SQL} AS domain,
                   trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS t
            FROM documents
        ),
        docs AS (
            SELECT doc_id, domain, lang, source,
                   CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, ' ', '')) + 1 END AS tokens
            FROM words
        ),
        supply AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS supply FROM docs GROUP BY ALL),
        caps AS (SELECT *, supply * 2.0::DOUBLE AS cap FROM supply),
        top AS (SELECT least(sum(cap), 0.8::DOUBLE * sum(supply)) AS budget FROM caps),
        {_level_sql("d", "", "domain", _DOMAIN_WEIGHT_SQL, "top")},
        {_level_sql("l", "domain", "lang", _LANG_WEIGHT_SQL, "d")},
        {_level_sql("s", "domain, lang", "source", "1", "l")},
        quotas AS (
            SELECT s.domain, s.lang, s.source, coalesce(CAST(floor(s.budget / nullif(q.supply, 0)) AS BIGINT), 0) AS fullepochs, s.budget, q.supply
            FROM s JOIN supply q USING (domain, lang, source)
        ),
        placed AS (
            SELECT d.doc_id, d.domain, d.lang, d.source, q.fullepochs,
                   CAST(floor(q.budget - q.fullepochs * q.supply) AS BIGINT) AS rest,
                   coalesce(sum(d.tokens) OVER (
                       PARTITION BY d.domain, d.lang, d.source ORDER BY md5(concat_ws(':', '5', CAST(q.fullepochs AS VARCHAR), CAST(d.doc_id AS VARCHAR)))
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM docs d JOIN quotas q USING (domain, lang, source)
        )
        SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch
        FROM placed, unnest(range(0, fullepochs + CASE WHEN before < rest THEN 1 ELSE 0 END)) AS e(epoch)
    """,
    "op8_licenses": f"""
        WITH texts AS (SELECT doc_id, NULL AS license, coalesce(text, '') AS t FROM documents UNION ALL SELECT NULL, v.license, v.t FROM (VALUES {_LICENSES_SQL}) AS v(license, t)),
        lowered AS (SELECT doc_id, license, {_SPELLINGS_SQL} AS t FROM texts),
        canonical AS (
            SELECT doc_id, license, regexp_replace(regexp_replace(t, '(?m)^[^\\p{{L}}\\p{{N}}\\n(©]*(?:copyright\\b|\\(c\\)|©)[^\\n]*\\n?', '', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS t FROM lowered
        ),
        known AS (SELECT md5(trim(regexp_replace(t, '[\\x20\\n]+', ' ', 'g'))) AS digest, min(license) AS license FROM canonical WHERE license IS NOT NULL GROUP BY 1),
        units AS (
            SELECT doc_id, t AS u FROM canonical WHERE license IS NULL
            UNION ALL SELECT doc_id, unnest(regexp_split_to_array(t, '\\n\\x20*\\n')) FROM canonical WHERE license IS NULL
            UNION ALL SELECT doc_id, unnest(string_split(t, chr(10))) FROM canonical WHERE license IS NULL
        ),
        digests AS (SELECT DISTINCT doc_id, md5(trim(regexp_replace(u, '[\\x20\\n]+', ' ', 'g'))) AS digest FROM units),
        hits AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM digests JOIN known USING (digest) GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_matches, coalesce(names, '') AS licenses FROM documents LEFT JOIN hits USING (doc_id)
    """,
    "op5_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY norm) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
               sha256(norm) AS text_sha256
        FROM t
    """,
}
