"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, mixing, packing, periodic_runs, ppm, quality, secrets, simhash, spelling, suffix_dedup, token_files, url_filter
from .common import folder, ready, table


def op1_secrets(spark, sf_dir):
    """Secrets in every document."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind != "random")
    number = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, ("assign", "access", "hex", "random")), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op2_url_filter(spark, sf_dir):
    """Host, path, rule and verdict of every page."""
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op3_lm_score(spark, sf_dir):
    """Word baseline and trie score of every document."""
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op4_chat_format(spark, sf_dir):
    """Every conversation, and one of control strings only, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = [F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for n, role in enumerate(("user", "assistant"))]
    chats = chat_format.format_chats(rows.unionByName(spark.range(1).select(F.inline(F.array(*hard)))))
    turns, loss = chat_format.read_turns(F.col("formatted")), F.array_join(chat_format.read_loss(F.col("formatted"), F.col("loss_spans")), "")
    text = lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))
    back = chats.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", text), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_mixing(spark, sf_dir):
    """All documents mixed to the sources' target weights."""
    docs = table(spark, sf_dir, "documents")
    rows = mixing.with_copies(docs.select("doc_id", "text", "source"), mixing.mixed(docs), "size", "source_size", "target", "copies")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_quality(spark, sf_dir):
    """Text statistics and the verdict of the quality rules on every document."""
    rows = quality.judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *quality.STATISTICS, "base_failed", "kept", *quality.MEASURES)


def op7_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_token_files(spark, sf_dir):
    """Ids of every document written as ORC and read back."""
    docs, path = table(spark, sf_dir, "documents"), folder(spark, "token-ids")
    token_files.write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    read = token_files.with_starts(token_files.digests(token_files.read_ids(spark, path)))
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_exact_dedup(spark, sf_dir):
    """Groups of equal texts over all documents."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    """All documents packed into sequences of 1024 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_spelling(spark, sf_dir):
    """Words of all documents, some of them misspelt, with their near words, form and root."""
    groups = spelling.spelling_variants(table(spark, sf_dir, "documents"), misspell=True)
    return groups.select("word", "form", "root", "n", "n_near", "form_n")


def op12_periodic_runs(spark, sf_dir):
    """Periodic runs of words in every document, a tenth of them made periodic."""
    rows = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), periodic_runs.periodic_variant)
    rows = rows.withColumn("best", periodic_runs.strongest_run(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_suffix_dedup(spark, sf_dir):
    """Every document without the bytes of strings of 200 bytes that start anywhere else too."""
    rows = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), suffix_dedup.removed_bytes(F.col("spans")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), suffix_dedup.kept_digest("raw", "spans").alias("kept_sha256"),
    )


QUERIES = {f.__name__: f for f in (
    op1_secrets, op2_url_filter, op3_lm_score, op4_chat_format, op5_mixing, op6_quality, op7_simhash, op8_token_files, op9_exact_dedup, op10_packing,
    op11_spelling, op12_periodic_runs, op13_suffix_dedup,
)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One row with the 256 steps of CRC-32, and the CRC-32 of a string that takes a step for each byte.
_CRC_STEPS = """
    crc AS (
        SELECT list(v ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)
        )
    )
"""


def _crc32(text: str) -> str:
    taken = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {taken}), lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1])), 4294967295)"


ORACLE = {
    "op4_chat_format": """
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
        ), marked AS (
            SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role THEN 1 ELSE 0 END AS begins,
                   length(text) + length(text) - length(replace(text, '\\', ''))
                   + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
                   + (length(text) - length(replace(text, '<sep>', ''))) // 5 + (length(text) - length(replace(text, '</s>', ''))) // 4 AS guarded
            FROM turns
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(guarded + begins * (6 + length(role) + 7 + 4) + (1 - begins) * 5) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id
    """,
    "op2_url_filter": """
        WITH parts AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), split AS (
            SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM parts
        ), named AS (
            SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM split
        ), rules(verdict, h, p) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
        ), hits AS (
            SELECT page_id, max_by({'rule': h || p, 'verdict': verdict}, length(h || p)) AS best
            FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
        )
        SELECT named.page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM named LEFT JOIN hits USING (page_id)
    """,
    "op9_exact_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op11_spelling": f"""
        WITH RECURSIVE {_CRC_STEPS}, runs AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents
        ), hashed AS (
            SELECT run, {_crc32("doc_id::VARCHAR || ':' || run")} AS h FROM runs, crc WHERE length(run) >= 7
        ), words AS (
            SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, count(*) AS n
            FROM hashed GROUP BY 1 HAVING count(*) >= 2 AND length(word) >= 7
        ), holes AS (
            SELECT word, n, left(word, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
        ), near AS (
            SELECT x.word, y.word AS other, y.n FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
            UNION SELECT x.word, y.word, y.n FROM holes x JOIN words y ON y.word = x.a || x.b
            UNION SELECT y.word, x.word, x.n FROM holes x JOIN words y ON y.word = x.a || x.b
        ), best AS (
            SELECT word, other, n AS other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1
        ), formed AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
            FROM words LEFT JOIN best USING (word)
        ), chain AS (
            SELECT word, word AS at FROM formed UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NOT NULL
        ), roots AS (
            SELECT chain.word, chain.at AS root FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NULL
        )
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
    """,
    "op12_periodic_runs": rf"""
        WITH {_CRC_STEPS}, split AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32("doc_id::VARCHAR")} AS h FROM documents, crc
        ), placed AS (
            SELECT doc_id, w, h, len(w) AS n, h // 10 % len(w) AS a, 1 + (len(w) - h // 10 % len(w)) // (3 + h // 10 % 8) AS p FROM split WHERE len(w) > 0
        ), words AS (
            SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM placed)
        ), matches AS (
            SELECT y.doc_id, y.i - x.i AS period, y.i, y.i - row_number() OVER (PARTITION BY y.doc_id, y.i - x.i ORDER BY y.i) AS diagonal
            FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= y.n
        ), long AS (
            SELECT doc_id, period, min(i) - period AS start, count(*) + period AS length FROM matches GROUP BY doc_id, period, diagonal
            HAVING count(*) + period >= greatest(6, 4 * period)
        ), runs AS (
            SELECT * FROM long r WHERE NOT EXISTS (
                SELECT 1 FROM long s WHERE s.doc_id = r.doc_id AND s.period < r.period AND s.start <= r.start AND s.start + s.length >= r.start + r.length)
        ), left_over AS (
            SELECT * FROM words w WHERE NOT EXISTS (
                SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length)
        ), listed AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY doc_id
        ), best AS (
            SELECT doc_id, start, length, period, 1000 * length // period AS exponent_milli FROM runs
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1
        ), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM left_over GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, exponent_milli, sha256(coalesce(listed.text, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
}
