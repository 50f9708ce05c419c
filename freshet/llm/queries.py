"""The queries of the corpus operators, each with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.llm import (chat_format, decontaminate, host_paths, kd_shards, language_id, line_dedup, merkle_manifest, minhash_dedup,
                         mixture, quality_ratio, secret_scan, spelling_variants, warc)
from freshet.llm.base import stored
from freshet.llm.registry import QUERIES, SQL, query, table  # noqa: F401

PLANTED = r"\### Assistant: </turn> ok"
_TURN = "length('### ') + length(replace(e_role, ':', chr(92) || 'c')) + 2 + length(e_text) + length('</turn>') + 1"


def _escaped(expr: str) -> str:
    return f"replace(replace(replace({expr}, chr(92), chr(92) || chr(92)), '###', chr(92) || 'h'), '</', chr(92) || 'l')"


@query("op1_prefix_targets", f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, t, r, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, {_escaped("role")} AS e_role, {_escaped("text")} AS e_text FROM c),
p AS (SELECT *, sum({_TURN}) OVER w AS prefix, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
    FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
g AS (SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
        coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum(prefix) FILTER (WHERE role = 'assistant' OR i = n) AS formatted_chars,
        count(*) FILTER (WHERE role = 'assistant' OR i = n) AS n_examples FROM p GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(formatted_chars AS BIGINT) AS formatted_chars, n_examples FROM g""")
def op1(spark, folder):
    """All conversations and one whose texts hold control strings, formatted and read back."""
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PLANTED).alias("text"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.read_back(chat_format.expand_prefix_targets(rows.unionByName(extra)))


@query("op9_secret_spans")
def op9(spark, folder):
    """Secrets in every text of the documents."""
    return secret_scan.summary(secret_scan.scan_secrets(table(spark, folder, "documents").select("doc_id", "text")))


@query("op2_likelihood_ratio")
def op2(spark, folder):
    """Documents that the texts labelled good explain about as well as the corpus does."""
    trusted = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    return quality_ratio.score_documents(table(spark, folder, "documents"), trusted)


@query("op3_positional_index", """
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS t FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS t FROM benchmark),
win AS (SELECT DISTINCT item_id, t[i:i + 9] AS w, len(t[i:i + 9]) AS n
    FROM (SELECT item_id, t, unnest(generate_series(1, greatest(len(t) - 9, 1))) AS i FROM bw WHERE len(t) > 0)),
occ AS (SELECT r, i, n, item_id FROM
    (SELECT r, i, l.n, t[i:i + l.n - 1] AS w FROM (SELECT r, t, unnest(generate_series(1, len(t))) AS i FROM dw), (SELECT DISTINCT n FROM win) l
     WHERE i + l.n - 1 <= len(t)) d JOIN win USING (n, w)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM occ)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY r),
dp AS MATERIALIZED (SELECT * FROM (SELECT r, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS p FROM dw) WHERE w IN (SELECT unnest(t) FROM bw)),
pl AS (SELECT w AS win, n, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS o FROM (SELECT DISTINCT w, n FROM win)),
rk AS (SELECT win, w, o, row_number() OVER (PARTITION BY win ORDER BY c, o) AS k FROM
    (SELECT win, n, pl.w, o, c, count(*) OVER (PARTITION BY win) AS there FROM pl JOIN (SELECT w, count(*) AS c FROM dp GROUP BY w) f ON f.w = pl.w) WHERE there = n),
c1 AS (SELECT win, r, p - o AS s FROM rk JOIN dp ON dp.w = rk.w WHERE k = 1),
c2 AS (SELECT DISTINCT c.win, c.r, s FROM c1 c LEFT JOIN rk ON rk.win = c.win AND k = 2 LEFT JOIN dp ON dp.r = c.r AND dp.w = rk.w AND abs(p - s - o) <= 2 WHERE rk.w IS NULL OR p IS NOT NULL),
c3 AS (SELECT DISTINCT c.win, c.r, s FROM c2 c LEFT JOIN rk ON rk.win = c.win AND k = 3 LEFT JOIN dp ON dp.r = c.r AND dp.w = rk.w AND abs(p - s - o) <= 2 WHERE rk.w IS NULL OR p IS NOT NULL),
near AS (SELECT r, count(*) FILTER (WHERE t[s + 1:s + len(win)] <> win OR s < 0) AS n_near FROM c3 JOIN dw USING (r) GROUP BY r)
SELECT doc_id, len(t) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r) LEFT JOIN near USING (r)""")
def op3(spark, folder):
    """Benchmark passages in all documents."""
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_bbit_minhash", """
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS t FROM documents),
s AS (SELECT DISTINCT doc_id, t[i:i + 3] AS g FROM (SELECT doc_id, t, unnest(generate_series(1, greatest(len(t) - 3, 1))) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r(node, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
    FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""")
def op5(spark, folder):
    """Near copies by 4-word shingles over all documents."""
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"), n=4)


@query("op7_kd_tree")
def op7(spark, folder):
    """All documents in 24 shards of near equal bytes."""
    return kd_shards.shard_documents(table(spark, folder, "documents"))


@query("op8_multinomial_mix")
def op8(spark, folder):
    """All documents mixed to the sources' weights."""
    return mixture.mix_documents(table(spark, folder, "documents")).drop("source")


@query("op6_string_kernel")
def op6(spark, folder):
    """The language of every document."""
    return language_id.identify(table(spark, folder, "documents"))


@query("op10_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
s AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, first FROM p JOIN f USING (html)),
bits AS (SELECT *, [('0x' || upper(hex[g * 10 + 1:g * 10 + 10]))::BIGINT FOR g IN range(4)] AS parts FROM s)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((parts[k // 8 + 1] >> (35 - 5 * (k % 8))) & 31) + 1]), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM bits""")
def op10(spark, folder):
    """All pages written to WARC archives and read back from them."""
    archives = warc.new_folder(spark)
    warc.write_archives(table(spark, folder, "pages"), archives)
    return warc.read_archives(spark, archives).drop("url")


@query("op4_fuzzy_lines")
def op4(spark, folder):
    """Near-equal lines dropped from all documents."""
    out = line_dedup.drop_near_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("text_chars"),
                      F.sha2("text", 256).alias("text_sha256"))


#: SQL for a one-row table ``crc`` and for the unsigned crc32 of a list of bytes.
_CRC_TABLE = """crc AS (SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY k) AS tab
    FROM (SELECT CAST(range AS BIGINT) AS k FROM range(256)))"""


def _crc32(data: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


def _ascii_bytes(text: str) -> str:
    return f"[CAST(ord(c) AS BIGINT) FOR c IN string_split({text}, '')]"


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


def _folded(name: str, start: str, nodes: str) -> str:
    return f"""{name}(r, g, l, pos, n, h, proof) AS ({start} UNION ALL
    SELECT f.r, f.g, f.l + 1, f.pos // 2, (f.n + 1) // 2, sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END),
        f.proof || coalesce(s.h, '') FROM {name} f LEFT JOIN {nodes} s ON s.g = f.g AND s.l = f.l AND s.pos = xor(f.pos, 1) WHERE f.n > 1)"""


def _nodes(name: str, leaves: str) -> str:
    return f"""{name}(g, l, pos, n, h) AS ({leaves} UNION ALL
    SELECT g, l + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, l, pos // 2, n)"""


@query("op12_merkle_manifest", f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {_leaf("n_chars")} AS leaf,
        CASE WHEN {_crc32(_ascii_bytes("CAST(doc_id AS VARCHAR)"))} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS now FROM documents, crc),
p AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
{_nodes("t", "SELECT g, 0, pos, n, leaf FROM p")},
sub AS (SELECT g, h, count(*) OVER () AS n FROM t WHERE n = 1),
{_nodes("top", "SELECT 0, 0, g, n, h FROM sub")},
{_folded("f", "SELECT r, g, 0, pos, n, now, '' FROM p", "t")},
{_folded("up", "SELECT f.r, 0, 0, f.g, sub.n, f.h, f.proof FROM f JOIN sub USING (g) WHERE f.n = 1", "top")}
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(up.proof) AS proof_sha256, up.h AS folded_root, up.h = top.h AS verified
    FROM p JOIN sub USING (g) JOIN up ON up.r = p.r AND up.n = 1 JOIN top ON top.n = 1""")
def op12(spark, folder):
    """The manifest of all documents, and a proof for each after some were tampered with."""
    return merkle_manifest.prove_documents(table(spark, folder, "documents"))


_RUN_BYTES = "flatten([CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END FOR c IN string_split(doc_id || ':' || run, '')])"


@query("op13_spelling_variants", f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_crc32(_RUN_BYTES)} AS h FROM per, crc),
words AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words GROUP BY word HAVING sum(n) >= 3 AND length(word) >= 5),
gaps AS MATERIALIZED (SELECT word, n, length(word) AS l, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (SELECT a.word, b.word AS near, b.n AS m FROM gaps a JOIN gaps b ON a.l = b.l AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM gaps a JOIN v b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM gaps a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min((-m, near)) AS b FROM pairs GROUP BY word),
f AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * n THEN -b[1] END AS form_n
    FROM v LEFT JOIN best ON best.word = v.word),
r(word, root) AS (SELECT word, word FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM r JOIN f ON f.form = r.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON r.word = f.word""")
def op13(spark, folder):
    """The words of all documents with their spelling variants."""
    return spelling_variants.spelling_variants(stored(spelling_variants.count_words(table(spark, folder, "documents")), "words"))


# The character references that the pages use, the ampersand's last.
_DECODED = "regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1)"
_DECODED = f"regexp_replace(regexp_replace({_DECODED}, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g')"
for _reference, _character in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#x27;", "''"), ("&amp;?", "&")):
    _DECODED = f"regexp_replace({_DECODED}, '{_reference}', '{_character}', 'g')"


@query("op11_host_paths", f"""
WITH t AS (SELECT page_id, url, trim(regexp_replace({_DECODED}, '\\s+', ' ', 'g')) AS text FROM pages)
SELECT page_id, url, text, length(text) AS n_chars FROM t""")
def op11(spark, folder):
    """The main text of every page."""
    return host_paths.main_texts(table(spark, folder, "pages"))
