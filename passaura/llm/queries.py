"""The queries of this subpackage, each over the whole of its table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import chat_formatting, decontamination, document_fingerprints, edit_token_counts, filter_audit, html_extraction, quality_classifier, sentencepiece_codec, simhash_near_dedup, source_divergence, substring_dedup, token_packing, url_filters
from .common import table

#: Where the public tokenizers' files lie.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def op1_document_fingerprints(spark, sf_dir):
    """Fingerprints are returned whole, in hexadecimal digits: `document_fingerprints.Fingerprint` reads, adds and compares them."""
    found = document_fingerprints.against_next(table(spark, sf_dir, "documents"))
    digits = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select("doc_id", "n_chars", "edited_sha256", digits("fingerprint"), digits("edited_fingerprint"), "near_edited", "near_next")


def document_edits(spark, sf_dir):
    """The part of op1_document_fingerprints that SQL can express: lengths and digests of the edited texts."""
    return op1_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op2_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort("found.items")
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), decontamination.is_contaminated(F.col("found")).alias("contaminated"),
    )


def op3_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = quality_classifier.trained(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.judgements(docs, model, F.col("source"), F.col("lang")).select("doc_id", "quality.*")


def op4_token_counts(spark, sf_dir):
    """Each text, and the text after two rounds of edits: a twentieth goes at a third and the first 40 characters come again in the middle; then the
    last is replaced, on the trees of the first round. n_chars_encoded is what the second round read besides its own edit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    third, twentieth = F.floor(n / 3).cast("int"), F.floor(n / 20).cast("int")
    edit = lambda start, stop, text: F.struct(start.alias("start"), stop.alias("stop"), text.alias("text"))
    middle = F.floor((n - twentieth) / 2).cast("int")
    edits = F.array(edit(third, third + twentieth, F.lit("")), edit(middle, middle, F.substring("text", 1, 40)))
    vocabulary = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    first = edit_token_counts.edit_counts(docs.withColumn("edits", edits), vocabulary, "edits", with_text=True)
    last = F.col("counts.n_chars_edited").cast("int")
    kept = first.select("doc_id", "counts", F.col("counts.text").alias("text"), F.array(edit(last - 1, last, F.lit("!"))).alias("edits"))
    found = edit_token_counts.edit_counts(kept, vocabulary, "edits", column="later", kept_col="counts")
    return found.select("doc_id", "counts.n_tokens", "later.n_tokens_edited", "later.n_chars_edited", (F.col("counts.n_chars_recounted") + F.col("later.n_chars_recounted")).alias("n_chars_recounted"), "later.n_chars_encoded")


def op6_token_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_packing.packed_globally(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op5_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = url_filters.labels_of_pages(pages, table(spark, sf_dir, "labels"))
    return url_filters.judged(pages, labelled).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def url_mined_verdicts(spark, sf_dir):
    """Rules at work: pages labelled by two of their url's tokens together, and what the rules mined from these labels say of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url").where("url is not null")
    bad = F.col("url").startswith("https://") & F.col("url").contains("/en/")
    labelled = pages.select("url", F.when(bad, "block").otherwise("allow").alias("verdict"))
    found = url_filters.judged(pages, labelled, rules=(), min_count=2)
    return found.select("page_id", "url", "judged.verdict")


def url_fixed_rules(spark, sf_dir):
    """The part of op5_url_filters that SQL can express: host, path and the fixed rule that fits."""
    url = F.col("url")
    host, path = url_filters.host_of(url), url_filters.path_of(url)
    rule = url_filters.fixed_rule(host, path)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"), rule["rule"].alias("rule"), rule["verdict"].alias("verdict"))


def op7_html_extraction(spark, sf_dir):
    found = html_extraction.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_sentencepiece_codec(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sentencepiece_codec.coded(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    lossless = sentencepiece_codec.is_lossless(F.col("text"), F.col("coded.decoded"))
    return found.select("doc_id", F.size("coded.ids").cast("long").alias("n_tokens"), "coded.ids", lossless.alias("lossless"))


def op9_substring_dedup(spark, sf_dir):
    found = substring_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), "removed_words", "text")


def op10_simhash_near_dedup(spark, sf_dir):
    found = simhash_near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_filter_interaction_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = filter_audit.audit(docs, table(spark, sf_dir, "labels"), F.col("lang"), filter_audit.text_filters(F.col("text")), repeats="E")
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_source_divergence_audit(spark, sf_dir):
    found = source_divergence.divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))
    return found.select("lang", "source", "part", "item", "value", "rank")


def op13_chat_formatting(spark, sf_dir):
    """All conversations, and conversation -1, whose texts are made of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    found = chat_formatting.formatted(rows.unionByName(odd))
    read = found.select("conv_id", "formatted", chat_formatting.turns_of(F.col("formatted")).alias("turns"), chat_formatting.text_under_loss(F.col("formatted"), F.col("loss")).alias("trained"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest, n = lambda c: F.sha2(c.cast("binary"), 256), lambda c: F.length(c).cast("long")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(said).alias("turns_sha256"), n(F.col("trained")).alias("loss_chars"), digest(F.col("trained")).alias("loss_sha256"), n(F.col("formatted")).alias("formatted_chars")
    )


def queries():
    found = (op1_document_fingerprints, op2_decontamination, op3_quality_classifier, op4_token_counts, op5_url_filters, op6_token_packing, op7_html_extraction, op8_sentencepiece_codec, op9_substring_dedup, op10_simhash_near_dedup, op11_filter_interaction_audit, op12_source_divergence_audit, op13_chat_formatting, document_edits, url_fixed_rules, url_mined_verdicts)
    return {f.__name__: f for f in found}


_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT item_id, w, least(13, len(w)) AS l FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, l, array_to_string(w[p : p + l - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS p FROM x)),
dw AS (SELECT doc_id, l, p, array_to_string(w[p : p + l - 1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM x))),
h AS (SELECT doc_id, item_id, dw.l, p FROM dw JOIN iw ON dw.l = iw.l AND dw.g = iw.g),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


def _rule_sql(of: int) -> str:
    """The longest fixed rule (0: itself, 1: its verdict) that fits a host and a path."""
    out = ""
    for verdict, rule in sorted(url_filters.RULES, key=lambda x: -len(x[1])):
        host, path = rule[: rule.index("/")], rule[rule.index("/") :]
        out += f" when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}') then '{(rule, verdict)[of]}'"
    return f"case{out} end"


_URL_RULES = rf"""
SELECT page_id, host, path, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS verdict
FROM (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages) p
"""


_OP11 = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(w.doc_id > first, false) THEN 'E' ELSE '' END AS f
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, f, good, toxic, count(*) AS n FROM d GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, o[step] AS letter, o[1 : step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
m AS (SELECT part, o AS filter_order, step, letter, n, good, toxic, f, contains(f, letter) AS here, length(translate(earlier, f, '')) < length(earlier) AS gone FROM c, s),
r AS (SELECT part, filter_order, step, letter,
  coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (here AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (f = letter), 0) AS unique_fails, coalesce(sum(n) FILTER (here AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (here AND NOT gone AND toxic), 0) AS toxic_lost
  FROM m GROUP BY ALL)
SELECT part, filter_order, cast(step AS integer) AS step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed, cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails,
  cast(good_lost AS bigint) AS good_lost, cast(toxic_lost AS bigint) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, letter) AS bigint) AS shapley FROM r
"""

_OP12 = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + cast(1000000000 AS hugeint) * (coalesce(c.n, 0) + 2) // (coalesce(gn.total, 0) + 2 * v.v) AS p
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
ln AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
q AS (SELECT lang, term, 1 + cast(1000000000 AS hugeint) * (sum(n) + 2) // (any_value(ln.total) + 2 * any_value(v.v)) AS q FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
x AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, cast(value AS bigint) AS value, cast(rank AS integer) AS rank FROM x WHERE part = 'pair' OR rank <= 10
"""

_OP13 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, '(<)(\\*(?:\|(?:start|message|end|image|audio|document|im_start|im_end|endoftext|eot_id)\|>|/?s>))|(\[)(\\*/?INST\])' AS p FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text), '')) AS turns_sha256,
       cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       cast(sum(length('<|start|><|message|><|end|>') + length(regexp_replace(role, p, '\1\3\\\2\4', 'g')) + length(regexp_replace(text, p, '\1\3\\\2\4', 'g'))) AS bigint) AS formatted_chars
FROM e GROUP BY conv_id
"""


_URL_MINED = "SELECT page_id, url, case when starts_with(url, 'https://') and contains(url, '/en/') then 'block' else 'allow' end AS verdict FROM pages WHERE url IS NOT NULL"


_EDITS = """
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 3) || substr(n, 1, length(t) // 3)) AS edited_sha256
FROM (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS n FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d WINDOW w AS (ORDER BY doc_id DESC)) x
"""


def oracle_sql():
    return {"document_edits": _EDITS, "op2_decontamination": _OP2, "url_fixed_rules": _URL_RULES, "url_mined_verdicts": _URL_MINED, "op11_filter_interaction_audit": _OP11, "op12_source_divergence_audit": _OP12, "op13_chat_formatting": _OP13}
