"""One query per operator: the operator over its whole table, with the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hazardgrid.llm import decontam, exact, language, personal, pieces, prefixes, repetition, simhash, substrings, toxicity, urllists, warc, whitening
from hazardgrid.llm.common import held_out, read_table
from hazardgrid.llm.registry import query
from hazardgrid.session import stage


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, count=1, most=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


@query("op10_repetition")
def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.repetition(read_table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~F.col("repetitive")).alias("kept"), "n_lines", "dup_line_chars", "dup_shares")


def _written(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op5_personal_data")
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.personal_data(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["disguised"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, personal.KINDS), F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["disguised"])).cast("bigint").alias("n_disguised"))


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    found = pieces.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op4_warc")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    folder = warc.new_folder(spark)
    warc.write_archives(warc.plan_records(pages, "page_id", "url", "html"), folder)
    columns = "record_type string, record_id string, payload_digest string, refers_to string, payload_bytes bigint, digest_ok boolean"

    def page(c):
        return F.regexp_extract(c, r"^<urn:record:(-?\d+)>$", 1).try_cast("bigint")

    return warc.read_archives(spark, folder, columns).select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"), "digest_ok")


@query("op7_url_lists", """
WITH hosts AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*[^/?#:.])', 1)) AS host FROM pages),
     named AS (SELECT host, CAST(('0x' || substr(md5(host), 1, 6)) AS BIGINT) AS n FROM hosts WHERE host <> ''),
     events AS (
       SELECT 'host' AS kind, host AS entry, CASE WHEN n % 3 = 0 THEN 'allow' ELSE 'block' END AS action, DATE '2023-01-01' + CAST(n % 700 AS INT) AS day FROM named
       UNION ALL SELECT 'host', host, 'remove', DATE '2023-01-01' + CAST(n % 700 + 1 + n % 97 AS INT) FROM named WHERE n % 2 = 0
       UNION ALL SELECT 'host', host, 'block', DATE '2023-01-01' + CAST(n % 700 + 200 AS INT) FROM named WHERE n % 4 = 0
       UNION ALL SELECT 'domain', regexp_replace(host, '^[^.]*[.]', ''), 'block', DATE '2023-01-01' + CAST(n % 700 AS INT) FROM named WHERE n % 5 = 0 AND contains(host, '.')
       UNION ALL SELECT 'domain', regexp_replace(host, '^[^.]*[.]', ''), 'remove', DATE '2023-01-01' + CAST(n % 700 + 3 AS INT) FROM named WHERE n % 5 < 2 AND contains(host, '.')),
     daily AS (SELECT kind, entry, day, max(CASE action WHEN 'block' THEN 3 WHEN 'allow' THEN 2 ELSE 1 END) AS r FROM events GROUP BY 1, 2, 3),
     spans AS (SELECT *, lead(day) OVER (PARTITION BY kind, entry ORDER BY day) AS until FROM daily),
     caps AS (SELECT page_id, url, DATE '2023-01-01' + CAST((page_id * 37) % 1000 AS INT) AS fetched_on,
                     lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*[^/?#:.])', 1)) AS host FROM pages),
     hits AS (SELECT c.page_id, c.url, s.kind, s.entry, s.r, s.day,
                     row_number() OVER (PARTITION BY c.page_id, c.url ORDER BY s.kind DESC, length(s.entry) DESC, s.entry DESC) AS k
              FROM caps c JOIN spans s ON s.r > 1 AND s.day <= c.fetched_on AND (s.until IS NULL OR c.fetched_on < s.until)
               AND ((s.kind = 'host' AND s.entry = c.host) OR (s.kind = 'domain' AND (s.entry = c.host OR ends_with(c.host, '.' || s.entry)))))
SELECT c.page_id, c.fetched_on, CASE h.r WHEN 3 THEN 'block' WHEN 2 THEN 'allow' ELSE 'none' END AS verdict, h.kind AS matched_kind, h.entry AS matched_entry, h.day AS listed_on
FROM caps c LEFT JOIN hits h ON h.k = 1 AND h.page_id = c.page_id AND h.url = c.url
""")
def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages get a fetch day from their id; the lists are dated events on the hosts and domains that occur in the pages."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    start = F.to_date(F.lit("2023-01-01"))

    def on(days):
        return F.date_add(start, days.cast("int")).alias("day")

    named = pages.select(urllists.host_of(F.col("url")).alias("host")).distinct().filter("host <> ''").withColumn(
        "n", F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 6), 16, 10).cast("bigint"))
    named = stage(named, "url-hosts")
    n, parent, has_parent = F.col("n"), F.regexp_replace("host", r"^[^.]*\.", ""), F.contains("host", F.lit("."))

    def event(rows, kind, entry, action, days):
        return rows.select(F.lit(kind).alias("kind"), entry.alias("entry"), action.alias("action"), on(days))

    host = F.col("host")
    events = event(named, "host", host, F.when(n % 3 == 0, "allow").otherwise("block"), n % 700).unionByName(
        event(named.filter(n % 2 == 0), "host", host, F.lit("remove"), n % 700 + 1 + n % 97)).unionByName(
        event(named.filter(n % 4 == 0), "host", host, F.lit("block"), n % 700 + 200)).unionByName(
        event(named.filter((n % 5 == 0) & has_parent), "domain", parent, F.lit("block"), n % 700)).unionByName(
        event(named.filter((n % 5 < 2) & has_parent), "domain", parent, F.lit("remove"), n % 700 + 3))
    captures = pages.withColumn("fetched_on", F.date_add(start, ((F.col("page_id") * 37) % 1000).cast("int")))
    return urllists.judge(captures, events).drop("url")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), remainder=0)
    return found.select("doc_id", held_out("doc_id", 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op3_language_model")
def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.score_documents(read_table(spark, sf_dir, "documents"), remainder=1)
    return found.select("doc_id", held_out("doc_id", 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_substrings")
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(read_table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op13_exact", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.deduplicate(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=4)


@query("op11_prefix_trie", r"""
WITH turns AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
                      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
     own AS (SELECT conv_id, list({'id': id, 'words': words} ORDER BY turn NULLS FIRST, id) AS own FROM turns GROUP BY conv_id),
     bits AS (SELECT conv_id, [4294967295::UBIGINT] || flatten([[512::UBIGINT + ascii(c)] || [1024::UBIGINT for k in range(8)] for c in string_split(conv_id::VARCHAR, '')]) AS steps FROM own),
     crc AS (SELECT conv_id, (xor(list_reduce(steps, lambda acc, s: CASE WHEN s < 1024 THEN xor(acc, s - 512) ELSE xor(acc >> 1, 3988292384::UBIGINT * (acc & 1)) END),
                                  4294967295::UBIGINT) % 4)::BIGINT AS h FROM bits),
     rebuilt AS (SELECT o.conv_id, coalesce(b.own[1:h], []) || o.own[h + 1:] AS seq FROM own o JOIN crc USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
     members AS (SELECT conv_id, len(seq) AS size, d AS depth, [t.id for t in seq[1:d]] AS path, CASE WHEN d > 0 THEN seq[d].words ELSE 0 END AS words
                 FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM rebuilt)),
     nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
                      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256 FROM members GROUP BY path, depth),
     kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
     full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path, depth)),
     up AS (SELECT path[1:d] AS path, d AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
            FROM (SELECT *, unnest(range(depth + 1)) AS d FROM full_nodes) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, u.n_leaves, u.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN up u USING (path, depth) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.conversation_trie(read_table(spark, sf_dir, "conversations"))
