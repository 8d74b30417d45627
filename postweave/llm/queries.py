"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm import chat, exact_dedup, langid, licenses, merkle, minhash, mixing, pieces, pii, quality, urls, variants, warc
from postweave.llm.common import ascii_lower, table, text_of
from postweave.session import scratch_path


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.assign_revisits(table(spark, sf_dir, "pages")), path).collect()
    return warc.read_warc(spark, path, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "block_digest_ok")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


#: A user and an assistant whose texts look like the control strings of common templates.
PROBE_ID = -7
PROBE = r"\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    joined = chat.join_turns(chat.format_turns(turns.unionByName(probe)))
    read = chat.read_turns(joined)
    digest = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["in_loss"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


#: Fixed by the contract of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.fit_field(pii.training_texts(docs)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(table(spark, sf_dir, "documents")).drop("_text")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


#: Fixed by the contract of the query: letters of a run, and one of how many runs loses a letter.
RUN = "[A-Za-z\u00C0-\u00FF]+"
LOSES_ONE_IN = 199


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(
        F.regexp_extract_all(ascii_lower(text_of("text")), F.lit(RUN), F.lit(0))).alias("run"))
    # A run that is too short stays too short without a letter.
    runs = runs.filter(F.length("run") >= variants.MIN_LENGTH).withColumn(
        "_h", F.crc32(F.concat("_id", F.lit(":"), "run").cast("binary")))
    place = (F.col("_h") % F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    words = runs.select(F.when(F.col("_h") % LOSES_ONE_IN == 0, less).otherwise(F.col("run")).alias("word"))
    return variants.group_variants(variants.count_words(words))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    values = [tampered if c == "text" else F.col(c) for c in merkle.COLUMNS]
    built = merkle.build_manifest(docs, carry={"now": merkle.leaf_of(values)})
    folded = merkle.fold(F.col("now"), F.col("proof"))
    return built.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("proof_sha256"),
                        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


#: Fixed by the contract of the query: of three parts of the ids one is held out.
HELD_OUT = 1


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == HELD_OUT
    model = langid.fit_languages(docs.filter(~held_out))
    return langid.identify_languages(docs, model, carry={"held_out": held_out})


QUERIES = {f.__name__: f for f in [
    op1_exact_dedup, op2_warc, op3_mixing, op4_license_scan, op5_chat_format, op6_url_filter, op7_personal_data,
    op8_quality_rules, op9_near_dedup, op10_sentencepiece, op11_spelling_variants, op12_merkle_manifest,
    op13_language_id]}

_FITS = " UNION ALL ".join(
    f"SELECT '{h}{p}' AS rule, '{h}' AS rule_host, '{p}' AS rule_path, '{v}' AS rule_verdict" for h, p, v in RULES)

#: The unsigned crc32 of a text of code points up to 255, bit by bit.
_BYTES = (r"""list_prepend(4294967295, flatten(list_transform(string_split({text}, ''), lambda c: CASE
    WHEN c = '' THEN []::BIGINT[] WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
    ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END)))""")
_CRC = ("""xor(4294967295::BIGINT, list_reduce(""" + _BYTES + """, lambda a, b: list_reduce(
    list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))""")


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in [
        "doc_id::VARCHAR", "source::VARCHAR", "lang::VARCHAR", "n_chars::VARCHAR", text]]
    return f"sha256({' || '.join(parts)})"


SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
                   FROM documents),
        r AS (SELECT *, first_value(doc_id) OVER w AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size
              FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""",
    "op2_warc": """
        WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
                          sha1(coalesce(html, '')) AS payload_digest FROM pages),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to,
               true AS block_digest_ok
        FROM r""",
    "op5_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS n,
                     length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) AS m FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(8 + m + 8 + n + 7)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op6_url_filter": rf"""
        WITH rules AS ({_FITS}),
        s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest
              FROM pages),
        p AS (SELECT page_id,
                     translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
        f AS (SELECT page_id, host, path, rule, rule_verdict,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS place
              FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM f WHERE place = 1""",
    "op8_quality_rules": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
                     regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS bare FROM d),
        g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
              FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
        n AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(3)) AS k) GROUP BY doc_id),
        l AS (SELECT doc_id, source, line, translate(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
              FROM (SELECT doc_id, source, unnest(ls) AS line FROM w)),
        f AS (SELECT source, norm, min(doc_id) AS home FROM l GROUP BY source, norm
              HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) >
                     0.01 * (SELECT count(*) FROM d WHERE d.source IS NOT DISTINCT FROM l.source)),
        lost AS (SELECT l.doc_id, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))::BIGINT AS lost_chars
                 FROM l JOIN f ON f.norm = l.norm AND f.source IS NOT DISTINCT FROM l.source AND f.home <> l.doc_id
                 GROUP BY l.doc_id),
        s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(bare)::BIGINT AS word_chars,
                     (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                     coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_chars, 0)::BIGINT AS lost_chars
              FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN lost ON lost.doc_id = w.doc_id)
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars - lost_chars >= 0.5 * word_chars AS kept
        FROM s""",
    "op9_near_dedup": r"""
        WITH RECURSIVE
        w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                     lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS hits FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
              GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
              WHERE 100 * hits >= 75 * (p.n + q.n - hits)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x),
        m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
        SELECT m.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, m.doc_id = component_id AS kept
        FROM m LEFT JOIN n ON n.doc_id = m.doc_id""",
    "op11_spelling_variants": rf"""
        WITH RECURSIVE
        r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
        c AS (SELECT doc_id, run, count(*) AS times FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
        h AS (SELECT *, {_CRC.format(text="(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM c),
        w AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word,
                     sum(times)::BIGINT AS n FROM h GROUP BY word HAVING sum(times) >= 5),
        v AS (SELECT * FROM w WHERE length(word) >= 6),
        g AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
        l AS (SELECT a.word, b.word AS near FROM g a JOIN g b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
              UNION SELECT g.word, v.word FROM g JOIN v ON g.less = v.word
              UNION SELECT v.word, g.word FROM g JOIN v ON g.less = v.word),
        b AS (SELECT l.word, count(*) AS n_near, arg_min(near, struct_pack(m := -v.n, t := near)) AS best,
                     max(v.n) AS best_n FROM l JOIN v ON v.word = l.near GROUP BY l.word),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form,
                     CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
        p(word, tip) AS (SELECT word, word FROM f UNION ALL SELECT p.word, f.form FROM p JOIN f ON f.word = p.tip WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, p.tip AS root, f.n, f.n_near, f.form_n
        FROM f JOIN p ON p.word = f.word JOIN f z ON z.word = p.tip AND z.form IS NULL""",
    "op12_merkle_manifest": rf"""
        WITH RECURSIVE
        d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS t, {_leaf_sql("text")} AS leaf,
                     CASE WHEN {_CRC.format(text="coalesce(doc_id::VARCHAR, '')")} % 2 = 0 AND doc_id IS NOT NULL
                          THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS now FROM documents),
        k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
        a(t, lvl, pos, h, n) AS (
            SELECT t, 0, pos, leaf, count(*) OVER (PARTITION BY t) FROM k UNION ALL
            SELECT t, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM a WHERE n > 1
            GROUP BY t, lvl, pos // 3, n),
        s AS (SELECT t, lvl AS height, h AS subroot, row_number() OVER (ORDER BY t) - 1 AS spos FROM a WHERE n = 1),
        u(lvl, pos, h, n) AS (
            SELECT 0, spos, subroot, count(*) OVER () FROM s UNION ALL
            SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM u WHERE n > 1
            GROUP BY lvl, pos // 3, n),
        root AS (SELECT h AS root FROM u WHERE n = 1),
        x AS (SELECT row_number() OVER () AS id, k.*, subroot, spos, height FROM k JOIN s ON s.t = k.t),
        step AS (
            SELECT id, a.lvl, a.pos, a.h, a.pos = x.pos // (3 ** a.lvl)::BIGINT AS own
            FROM x JOIN a ON a.t = x.t AND a.n > 1 AND a.pos // 3 = x.pos // (3 ** (a.lvl + 1))::BIGINT
            UNION ALL
            SELECT id, x.height + u.lvl, u.pos, u.h, u.pos = x.spos // (3 ** u.lvl)::BIGINT
            FROM x JOIN u ON u.n > 1 AND u.pos // 3 = x.spos // (3 ** (u.lvl + 1))::BIGINT),
        proof AS (SELECT id, string_agg(h, '' ORDER BY lvl, pos) AS siblings FROM step WHERE NOT own GROUP BY id),
        fold(id, lvl, h) AS (
            SELECT id, 0, now FROM x UNION ALL
            SELECT fold.id, fold.lvl + 1, sha256(string_agg(CASE WHEN own THEN fold.h ELSE step.h END, '' ORDER BY pos))
            FROM fold JOIN step ON step.id = fold.id AND step.lvl = fold.lvl GROUP BY fold.id, fold.lvl)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256,
               folded_root, folded_root = root AS verified
        FROM x CROSS JOIN root LEFT JOIN proof ON proof.id = x.id
             JOIN (SELECT id, arg_max(h, lvl) AS folded_root FROM fold GROUP BY id) y ON y.id = x.id""",
}
