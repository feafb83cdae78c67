"""The registered queries: every operator over its whole table, with the columns its result is known by."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from chatloom.llm.exact_dedup import exact_duplicates
from chatloom.llm.html_text import extract_text
from chatloom.llm.importance import resample
from chatloom.llm.language import held_out, identify, learn
from chatloom.llm.manifest import merkle_manifest
from chatloom.llm.mixing import first_position, mix_sources
from chatloom.llm.packing import Packed, pack
from chatloom.llm.quality import ERROR, NEARLY, RISK, TOLERATED, quality_rules
from chatloom.llm.registry import query, table
from chatloom.llm.secrets import scan_secrets
from chatloom.llm.sharding import shard_by_bytes
from chatloom.llm.simhash import near_duplicates
from chatloom.llm.suffix_dedup import remove_repeats
from chatloom.llm.url_filter import filter_urls, rules_table

# fixed values: the rules (host, path, verdict) that the query judges pages by
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_URL_RULES_SQL = ", ".join(str(r) for r in URL_RULES)


@query(
    "op1_url_filter",
    f"""
    WITH rules(rule_host, rule_path, verdict) AS (VALUES {_URL_RULES_SQL}),
    rest AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
    parts AS (
      SELECT row_number() OVER () AS n, page_id,
             translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
      FROM rest),
    fits AS (
      SELECT n, rule_host || rule_path AS rule, verdict,
             row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
      FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
    FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
    """,
)
def op1_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


_TOLERATED_SQL = ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(TOLERATED))

QUALITY_CTES = rf"""
texts AS (SELECT doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT doc_id, stratum, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split)),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM repeats, range(5) r(d) GROUP BY doc_id),
measured AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         len(lines) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
  FROM split LEFT JOIN covered USING (doc_id)),
valued AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         [1000 * n_symbols // greatest(word_chars, 1), 1000 * n_capitals // greatest(word_chars, 1),
          1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_repeat_words // greatest(n_words, 1),
          least(1000, 10 * word_chars // greatest(n_words, 1)), 1000 - least(1000, 10 * word_chars // greatest(n_words, 1))] AS v
  FROM measured),
labelled AS (
  SELECT valued.*, quality = 1 AS good, substr(md5(doc_id::VARCHAR), 1, 1) >= '8' AS holdout
  FROM valued JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL),
fit AS (SELECT stratum, unnest(range(1, 7)) AS rule, unnest(v) AS value FROM labelled WHERE good AND NOT holdout),
reach AS (
  SELECT stratum, rule, value, count(*) OVER (PARTITION BY stratum, rule ORDER BY value DESC) AS reached,
         count(*) OVER (PARTITION BY stratum, rule) AS every FROM fit),
tolerated(share_rank, share) AS (VALUES {_TOLERATED_SQL}),
least_values AS (
  SELECT stratum, share_rank, rule, coalesce(max(value) FILTER (reached > share * every) + 1, 0) AS cut
  FROM reach, tolerated GROUP BY ALL),
sets AS (SELECT stratum, share_rank, list(cut ORDER BY rule) AS cuts FROM least_values GROUP BY ALL),
tried AS (
  SELECT sets.stratum, share_rank, good, list_bool_or(list_transform(list_zip(v, cuts), lambda z: z[1] >= z[2])) AS hit
  FROM labelled JOIN sets USING (stratum) WHERE holdout),
counted AS (
  SELECT stratum, share_rank, count(*) FILTER (good) AS n, count(*) FILTER (good AND hit) AS k, count(*) FILTER (hit AND NOT good) AS caught
  FROM tried GROUP BY ALL),
certified AS (
  SELECT * FROM counted
  WHERE n > 0 AND k < n * {RISK} AND (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))
    FROM (SELECT unnest(range(0, k + 1)) AS i)) <= {ERROR} / (SELECT count(DISTINCT stratum) FROM sets)),
nearly AS (SELECT *, max(caught) OVER (PARTITION BY stratum) AS most FROM certified),
used AS (SELECT stratum, min(share_rank) AS share_rank FROM nearly WHERE caught > 0 AND caught >= {NEARLY} * most GROUP BY stratum),
judged AS (
  SELECT valued.*, NOT base_failed AND NOT coalesce(list_bool_or(list_transform(list_zip(v, cuts), lambda z: z[1] >= z[2])), false) AS kept
  FROM valued LEFT JOIN (SELECT * FROM sets JOIN used USING (stratum, share_rank)) USING (stratum))
"""


@query(
    "op2_quality_rules",
    f"WITH {QUALITY_CTES} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged",
)
def op2_quality_rules(spark, sf_dir):
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


VOCABULARY = "byte_bpe_50k.json"


def digests(packed: Packed):
    """The pieces with the checksum of their ids."""
    checksums = packed.tokens.select("piece", F.crc32("ids").alias("ids_crc32"))
    return packed.pieces.join(checksums, "piece").drop("piece")


@query("op3_pack_sequences")
def op3_pack_sequences(spark, sf_dir):
    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return digests(packed).select(*columns)


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark, sf_dir):
    removed = remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    n_spans = F.size("spans").cast("bigint")
    return removed.select("doc_id", "n_bytes", n_removed.alias("n_removed"), n_spans.alias("n_spans"), "kept_sha256")


@query("op6_secret_scan")
def op6_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: s["by_pattern"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    digest = F.sha2(joined(plain), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), digest, joined(F.col("spans")).alias("spans"))


@query(
    "op9_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def op9_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("text_print")


@query("op7_mix_sources")
def op7_mix_sources(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    columns = ["doc_id", "size", "source_size", "target", "taken", first_position().alias("first_position")]
    return mixed.select(*columns).orderBy("first_position", "doc_id")  # what isn't taken has no position


@query("op8_shard_by_bytes")
def op8_shard_by_bytes(spark, sf_dir):
    rows = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    checksum = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", "size", checksum.alias("text_crc32"), "law", "shard", "slot", "grown_shard")


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text"))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")


def _crc32_sql(text: str) -> str:
    """CRC-32 in SQL: every byte is followed by the eight steps that shift it out."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    steps = f"flatten(list_transform(range(octet_length(encode({text}))), lambda i: [{byte}, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce({steps}, lambda c, x: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FEATURES_SQL = rf"regexp_extract_all({_LOWER_SQL.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op11_importance_resampling",
    f"""
    WITH docs AS (SELECT row_number() OVER () AS n, doc_id, {_FEATURES_SQL} AS f FROM documents),
    own AS (SELECT n, unnest(f) AS x FROM docs),
    wanted AS (SELECT unnest({_FEATURES_SQL}) AS x FROM benchmark),
    buckets AS (SELECT x, {_crc32_sql("x")} % 10000 AS b FROM (SELECT x FROM own UNION SELECT x FROM wanted)),
    s AS (SELECT b, count(*) AS s FROM own JOIN buckets USING (x) GROUP BY b),
    t AS (SELECT b, count(*) AS t FROM wanted JOIN buckets USING (x) GROUP BY b),
    gains AS (
      SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM own) + 10000)::DOUBLE
                                / ((s + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM s LEFT JOIN t USING (b)),
    weights AS (SELECT n, sum(gain)::BIGINT AS weight FROM own JOIN buckets USING (x) JOIN gains USING (b) GROUP BY n),
    scored AS (
      SELECT n, doc_id, len(f)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM docs LEFT JOIN weights USING (n)),
    ranked AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, rank
    FROM scored LEFT JOIN (SELECT * FROM ranked WHERE rank <= (SELECT count(*) FROM ranked) * 10 // 100) USING (n)
    """,
)
def op11_importance_resampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    drawn = resample(docs, table(spark, sf_dir, "benchmark"), percent=10, least_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _tree_sql(name: str, levels: int) -> str:
    """CTEs from ``name``_n0 (g, r, h): the nodes of every level, and beside each its siblings."""
    out = []
    for k in range(levels):
        now = f"(SELECT *, count(*) OVER (PARTITION BY g) > 1 AS open FROM {name}_n{k})"
        out.append(
            f"""{name}_s{k} AS (
      SELECT g, r, open, coalesce(string_agg(h, '') OVER (PARTITION BY g, r // 8 ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
             coalesce(string_agg(h, '') OVER (PARTITION BY g, r // 8 ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
      FROM {now}),
    {name}_n{k + 1} AS (
      SELECT g, r // 8 AS r, CASE WHEN bool_or(open) THEN sha256(string_agg(h, '' ORDER BY r)) ELSE min(h) END AS h FROM {now} GROUP BY g, r // 8)"""
        )
    return ",\n    ".join(out)


def _climb_sql(tree: str, levels: int, start: str, group: str, rank: str, name: str) -> str:
    """CTEs that lead the rows of ``start`` up: ``proof`` and ``fold`` grow by a level each."""
    out, before = [], start
    for k in range(levels):
        out.append(
            f"""{name}{k} AS (
      SELECT p.* EXCLUDE (proof, fold), proof || lft || rgt AS proof, CASE WHEN open THEN sha256(lft || fold || rgt) ELSE fold END AS fold
      FROM {before} p JOIN {tree}_s{k} s ON s.g = p.{group} AND s.r = p.{rank} // {8**k})"""
        )
        before = f"{name}{k}"
    return ",\n    ".join(out)


def _leaf_sql(text: str) -> str:
    fields = [f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')" for v in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


_GROUP_LEVELS, _TOP_LEVELS = 7, 3  # enough for two million rows of a language, and 512 languages


@query(
    "op12_merkle_manifest",
    f"""
    WITH made AS (
      SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql("text")} AS leaf,
             CASE WHEN coalesce({_crc32_sql("doc_id::VARCHAR")} % 3 = 0, false) THEN {_leaf_sql(_LOWER_SQL.format("text"))}
                  ELSE {_leaf_sql("text")} END AS fold
      FROM documents),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, '' AS proof FROM made),
    low_n0 AS (SELECT g, r, leaf AS h FROM leaves),
    {_tree_sql("low", _GROUP_LEVELS)},
    subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS top_r, 0 AS all_of FROM low_n{_GROUP_LEVELS}),
    top_n0 AS (SELECT all_of AS g, top_r AS r, subroot AS h FROM subroots),
    {_tree_sql("top", _TOP_LEVELS)},
    {_climb_sql("low", _GROUP_LEVELS, "leaves", "g", "r", "climb_low")},
    between AS (SELECT c.*, subroot, top_r, all_of FROM climb_low{_GROUP_LEVELS - 1} c JOIN subroots USING (g)),
    {_climb_sql("top", _TOP_LEVELS, "between", "all_of", "top_r", "climb_top")}
    SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified
    FROM climb_top{_TOP_LEVELS - 1}, (SELECT h FROM top_n{_TOP_LEVELS})
    """,
)
def op12_merkle_manifest(spark, sf_dir):
    made = merkle_manifest(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_DECODED_SQL = "b"
for _reference, _character in [("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#x27;", "''"), ("&amp;?", "&")]:
    _DECODED_SQL = f"regexp_replace({_DECODED_SQL}, '{_reference}', '{_character}', 'g')"


@query(
    "op13_html_text",
    # the pages of these tables hold their text in one article, in headings and paragraphs
    rf"""
    WITH blocks AS (
      SELECT row_number() OVER () AS n, page_id, url,
             regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>') AS bs
      FROM pages),
    texts AS (
      SELECT page_id, url, list_transform(bs, lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?[a-z][^>]*>', '', 'g')) AS bs FROM blocks),
    decoded AS (
      SELECT page_id, url, list_transform(bs, lambda b: trim(regexp_replace({_DECODED_SQL}, '\s+', ' ', 'g'))) AS bs FROM texts)
    SELECT page_id, url, array_to_string(list_filter(bs, lambda b: b <> ''), chr(10)) AS text,
           length(array_to_string(list_filter(bs, lambda b: b <> ''), chr(10))) AS n_chars
    FROM decoded
    """,
)
def op13_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
