"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.llm import (
    bpe, chat, decontaminate, merkle, near_duplicates, quality_rules, quality_trees, secrets, sharding, suffix_dedup, token_rollup,
    toxicity, vector_codes,
)
from beatloom.llm.store import read, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def byte_bpe() -> bpe.Tokenizer:
    return bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op1_decontaminate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("hits.items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


SQL["op1_decontaminate"] = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS window
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS window
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM doc_words, sizes WHERE len(w) >= size)),
hits AS (SELECT p.doc_id, p.i, p.size, x.item_id FROM places p JOIN windows x ON p.size = x.size AND p.window = x.window),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS j FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""


@_query
def op2_token_rollup(spark, sf_dir):
    """Load all documents; count texts with repeated lines anew without them;
    take the documents labelled toxic down; repeat two batches."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    lines = F.split("text", "\n")
    once = F.array_distinct(lines)
    short = F.when(F.size(once) < F.size(lines), F.array_join(once, "\n"))
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), quality_rules.BLANK), "")).cast("long")
    words_short = F.size(F.array_remove(F.split("short", quality_rules.BLANK), "")).cast("long")
    tokenizer = byte_bpe()
    counted = docs.withColumn("short", short).select(
        "doc_id", "source", "lang", F.col("short").isNotNull().alias("changed"),
        F.array(
            F.struct(F.lit("byte_bpe_50k").alias("version"), tokenizer.count("text").alias("old"), tokenizer.count("short").alias("new")),
            F.struct(F.lit("words_1").alias("version"), words.alias("old"), words_short.alias("new")),
        ).alias("counts"))
    counted = stored(counted, "counted").select("doc_id", "source", "lang", "changed", F.explode("counts").alias("c"))
    counted = counted.select("doc_id", "source", "lang", "changed", "c.version", "c.old", "c.new")
    toxic = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    tokens = F.when(F.col("changed"), F.col("new")).otherwise(F.col("old")).alias("tokens")
    key = ["source", "lang", "version"]
    load = token_rollup.inserts(counted.select(*key, F.col("old").alias("tokens")))
    shorten = token_rollup.revisions(counted.where("changed").select(
        *key, tokens, *[F.col(k).alias(f"old_{k}") for k in key], F.col("old").alias("old_tokens")))
    down = token_rollup.deletes(counted.join(toxic, "doc_id").select(*key, tokens))
    rollup = token_rollup.Rollup.fresh(spark)
    for name, batch in (("load", load), ("shorten", shorten), ("shorten", shorten), ("takedown", down), ("load", load)):
        rollup.commit(name, batch)
    return rollup.totals()


@_query
def op3_quality_trees(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    described = stored(quality_trees.with_statistics(docs).drop("text"), "statistics")
    forest = quality_trees.train(described, read(spark, sf_dir, "labels"), "quality")
    return quality_trees.score(described, forest).select(
        "doc_id", quality_trees.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


@_query
def op4_toxicity_chain(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).select(
        "doc_id", *[F.col(f"toxicity.{c}").alias(f"p_{c}") for c in toxicity.CATEGORIES], "toxicity.n_marked",
        (F.col("toxicity.toxic") >= 0.5).alias("toxic"),
    )


@_query
def op5_suffix_dedup(spark, sf_dir):
    length = F.aggregate("cut.spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    derive = {"n_bytes": F.col("cut.n_bytes"), "n_removed": length, "n_spans": F.size("cut.spans").cast("long"),
              "kept_sha256": F.sha2(F.col("cut.kept"), 256)}
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.deduplicate(docs, derive).select("doc_id", *derive)


@_query
def op6_byte_bpe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", byte_bpe().round_trip("text").alias("t")).select("doc_id", "t.ids", "t.decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@_query
def op7_sharding(spark, sf_dir):
    return sharding.shuffle_to_shards(read(spark, sf_dir, "documents"), 8)


@_query
def op9_chat_format(spark, sf_dir):
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    template = chat.Template(byte_bpe(), first_id=50_257)
    back = chat.read_back(chat.format_conversations(rows, template), template)
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@_query
def op8_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = stored(quality_rules.with_measures(docs).drop("text"), "measured")
    return quality_rules.judged(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_capitals", "host_flagged",
    )


SQL["op8_quality_rules"] = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words WHERE len(w) >= 3),
seen AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM places),
gaps AS (SELECT doc_id, least(3, i - lag(i, 1, -9) OVER (PARTITION BY doc_id ORDER BY i)) AS g FROM seen WHERE c > 1),
repeats AS (SELECT doc_id, sum(g) AS n FROM gaps GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         (length(text) - length(regexp_replace(text, '[A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}]', '', 'g')))::BIGINT AS n_capitals
  FROM words LEFT JOIN repeats USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
failed AS (
  SELECT source, doc_id, u.rule, u.strict, u.loose FROM based,
  LATERAL (VALUES ('symbols', 100 * n_symbols > 10 * n_words, 100 * n_symbols > 30 * n_words),
                  ('lines', 100 * n_dup_lines > 30 * n_lines, 100 * n_dup_lines > 60 * n_lines),
                  ('capitals', 100 * n_capitals > 30 * word_chars, 100 * n_capitals > 60 * word_chars)) u(rule, strict, loose)),
hosts AS (SELECT source, rule, count(*)::DOUBLE AS n, count(*) FILTER (strict)::DOUBLE AS f FROM failed GROUP BY ALL),
sums AS (SELECT rule, count(*) AS h, sum(n) AS n, sum(n * n) AS nn, sum(f) / sum(n) AS m, sum(f * f / n) AS sq FROM hosts GROUP BY rule),
rho AS (SELECT *, CASE WHEN m > 0 AND m < 1 AND h > 1 AND n - nn / n - h + 1 > 0
                  THEN (sq - n * m * m - m * (1 - m) * (h - 1)) / (m * (1 - m) * (n - nn / n - h + 1)) ELSE 0 END AS r FROM sums),
prior AS (SELECT rule, m, CASE WHEN r > 0 THEN least(1e6, greatest(1 / r - 1, 0)) ELSE 1e6 END AS s FROM rho),
verdict AS (SELECT source, rule, (f + m * s) / (n + s) > 0.2 AS strict_host FROM hosts JOIN prior USING (rule)),
final AS (
  SELECT doc_id, bool_or(f.loose OR (v.strict_host AND f.strict)) AS bad, bool_or(v.strict_host) AS host_flagged
  FROM failed f JOIN verdict v ON f.rule = v.rule AND f.source IS NOT DISTINCT FROM v.source GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR bad) AS kept, n_lines, n_capitals, host_flagged
FROM based JOIN final USING (doc_id)
"""


@_query
def op10_dart_minhash(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates.classes(docs).select("doc_id", "class_id", "n_class", "keep")


SQL["op9_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + length('</turn>' || chr(10)) + CASE role
    WHEN 'system' THEN length('### System: ') WHEN 'user' THEN length('### User: ') WHEN 'assistant' THEN length('### Assistant: ')
    ELSE length('### Role: ') + length(regexp_replace(role, '(\\|###|</turn>)', '\\\1', 'g')) + 1 END AS size
  FROM rows),
joined AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, sum(size)::BIGINT AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS trained
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(trained)::BIGINT AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars
FROM joined
"""


def _sharding_sql(shards: int = 8) -> str:
    """Row numbers, the Feistel network as nested steps, cycle walking as a
    recursive query, and crc32 over half bytes."""
    step = "{0}"
    for key in sharding.Feistel(2).keys:
        step = f"(SELECT * REPLACE (r AS l, xor(l, xor(y, y >> 13) & mask) AS r) FROM (SELECT * REPLACE ((y * {sharding.MIX[1]}) & {sharding.LOW32} AS y) FROM " \
               f"(SELECT * REPLACE (xor(y, y >> 15) AS y) FROM (SELECT * REPLACE ((r * {sharding.MIX[0]} + {key}) & {sharding.LOW32} AS y) FROM {step}))))"
    halves = "(SELECT id, n, h, mask, v >> h AS l, v & mask AS r, 0::UBIGINT AS y FROM {0})"
    once = "SELECT id, n, h, mask, (r << h) | l AS v FROM " + step.format(halves)
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    return f"""
WITH RECURSIVE hexed AS (SELECT doc_id, string_split(hex(encode(coalesce(text, ''))), '') AS c, octet_length(encode(coalesce(text, ''))) AS bytes FROM documents),
sized AS (
  SELECT doc_id, bytes + 1 AS size, xor(list_reduce(list_prepend({sharding.LOW32}::BIGINT, CASE WHEN bytes = 0 THEN []::BIGINT[] ELSE list_transform(range(2 * bytes),
    lambda j: (strpos('0123456789ABCDEF', c[CASE WHEN j % 2 = 0 THEN j + 2 ELSE j END]) - 1)::BIGINT) END),
    lambda acc, x: xor(acc >> 4, ({table})[(xor(acc, x) & 15) + 1]::BIGINT)), {sharding.LOW32}::BIGINT) AS crc FROM hexed),
numbered AS (SELECT *, (row_number() OVER (ORDER BY doc_id NULLS FIRST, size, crc) - 1)::UBIGINT AS id, (count(*) OVER ())::UBIGINT AS n FROM sized),
half AS (SELECT id, n, greatest(1, (length(bin(greatest(n, 2) - 1)) + 1) // 2)::UBIGINT AS h FROM numbered),
start AS (SELECT id, n, h, (1::UBIGINT << h) - 1 AS mask, id AS v FROM half),
walk AS ({once.format("start")} UNION ALL {once.format("(SELECT * FROM walk WHERE v >= n)")})
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (v % {shards})::INT AS shard, (v // {shards})::BIGINT AS slot, NULL::INT AS grown_shard
FROM numbered JOIN (SELECT id, v FROM walk WHERE v < n) USING (id)
"""


SQL["op7_sharding"] = _sharding_sql()
SQL["op5_suffix_dedup"] = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
strings AS (SELECT doc_id, i, md5_number(substr(h, (2 * i + 1)::BIGINT, 200)) AS s FROM (SELECT *, unnest(range(0, n - 99)) AS i FROM bytes WHERE n >= 100)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM strings) WHERE k > 1),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
         FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM later)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
parts AS (
  SELECT doc_id, a, b, substr(h, (2 * coalesce(lag(b) OVER w, 0) + 1)::BIGINT, (2 * (a - coalesce(lag(b) OVER w, 0)))::BIGINT) AS part
  FROM spans JOIN bytes USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
cut AS (SELECT doc_id, count(*) AS k, sum(b - a)::BIGINT AS removed, max(b) AS last, string_agg(part, '' ORDER BY a) AS head FROM parts GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(k, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM bytes LEFT JOIN cut USING (doc_id)
"""
SQL["op10_dart_minhash"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
runs AS (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS run
         FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM worded WHERE len(w) > 0)),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
total AS (SELECT doc_id, sum(c) AS n FROM counted GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS n FROM counted a JOIN counted b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common c JOIN total x ON x.doc_id = a JOIN total y ON y.doc_id = b WHERE c.n >= 0.8 * (x.n + y.n - c.n) - 1e-9
  UNION SELECT x.doc_id, y.doc_id FROM worded x JOIN worded y ON len(x.w) = 0 AND len(y.w) = 0 AND x.text = y.text AND x.doc_id < y.doc_id),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
class AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS n_class FROM reach GROUP BY a)
SELECT doc_id, class_id, n_class, doc_id = class_id AS keep FROM class
"""


# -- vector codes, Merkle manifest, secrets ---------------------------------
@_query
def op11_vector_codes(spark, sf_dir):
    coded, books = vector_codes.compress(read(spark, sf_dir, "embeddings"), n_parts=16, n_entries=64, rounds=2)
    return vector_codes.with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    def assigned(name: str, books: str) -> str:
        return f"""
{name} AS (
  SELECT vec_id, p, part, best % {entries} AS k, best // {entries} AS far FROM (
    SELECT q.vec_id, q.p, any_value(q.part) AS part,
           min(list_sum(list_transform(range(1, len(q.part) + 1), lambda i: (q.part[i] - b.part[i]) * (q.part[i] - b.part[i])))::HUGEINT * {entries} + b.k) AS best
    FROM parts q JOIN {books} b USING (p) GROUP BY q.vec_id, q.p))"""

    def averaged(name: str, given: str, books: str) -> str:
        return f"""
{name} AS (
  SELECT p, k, coalesce(m.part, b.part) AS part FROM {books} b LEFT JOIN (
    SELECT p, k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS part FROM (
      SELECT p, k, i, sum(part[i]) AS s, count(*) AS n FROM (SELECT p, k, part, unnest(range(1, len(part) + 1)) AS i FROM {given}) GROUP BY p, k, i)
    GROUP BY p, k) m USING (p, k))"""

    steps = []
    for r in range(rounds):
        steps += [assigned(f"a{r}", f"b{r}"), averaged(f"b{r + 1}", f"a{r}", f"b{r}")]
    steps.append(assigned(f"a{rounds}", f"b{rounds}"))
    return f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS part
          FROM (SELECT *, unnest(range({parts})) AS p FROM whole)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM whole ORDER BY vec_id LIMIT {entries}),
b0 AS (SELECT p, k, part FROM seeds JOIN parts USING (vec_id)),{",".join(steps)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', k::BIGINT), '' ORDER BY p) AS code, sum(far)::BIGINT AS error
          FROM a{rounds} JOIN whole USING (vec_id) GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, k)) AS digest FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM coded, books
"""


SQL["op11_vector_codes"] = _codes_sql()


@_query
def op12_merkle_manifest(spark, sf_dir):
    """Every document's proof; a third of the documents tampered with."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    struck = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    proofs = merkle.documents_manifest(docs, {"text": F.when(struck, lowered).otherwise(F.col("text"))})
    return proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def _merkle_sql() -> str:
    """Levels by a recursive query; siblings by joining a leaf's ancestor to
    its run; folding by a second recursive query.  crc32 over half bytes."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    low32 = 0xFFFFFFFF
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    up = lambda source: f"""
  SELECT * FROM {source} UNION ALL
  SELECT tree, level + 1, place // 8, sha256(string_agg(d, '' ORDER BY place)), (n + 7) // 8 FROM {{0}} WHERE n > 1 GROUP BY tree, level, place // 8, n"""
    path = lambda nodes, leaves: f"""
  SELECT l.id, x.level, coalesce(string_agg(s.d, '' ORDER BY s.place) FILTER (s.place < x.place), '') AS before,
         coalesce(string_agg(s.d, '' ORDER BY s.place) FILTER (s.place > x.place), '') AS after
  FROM {leaves} l JOIN {nodes} x ON x.tree = l.tree AND x.place = l.place // (8 ** x.level)::BIGINT AND x.n > 1
  JOIN {nodes} s ON s.tree = x.tree AND s.level = x.level AND s.place // 8 = x.place // 8 GROUP BY l.id, x.level"""
    return f"""
WITH RECURSIVE lowered AS (
  SELECT *, CASE WHEN xor(list_reduce(list_prepend({low32}::BIGINT, list_transform(range(2 * length(hexed)), lambda j:
      CASE WHEN j % 2 = 0 THEN (strpos('0123456789', hexed[j // 2 + 1]) - 1)::BIGINT ELSE 3 END)),
      lambda acc, x: xor(acc >> 4, ({table})[(xor(acc, x) & 15) + 1]::BIGINT)), {low32}::BIGINT) % 3 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed
  FROM (SELECT *, doc_id::VARCHAR AS hexed FROM documents)),
leaves AS (
  SELECT doc_id AS id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS d, {leaf("changed")} AS altered,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM lowered),
base AS (SELECT tree, 0 AS level, place, d, n FROM leaves),
nodes AS ({up("base").format("nodes")}),
subroots AS (SELECT tree AS id, 0 AS tree, d, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
over_base AS (SELECT tree, 0 AS level, place, d, n FROM subroots),
over_nodes AS ({up("over_base").format("over_nodes")}),
low AS ({path("nodes", "leaves")}),
high AS ({path("over_nodes", "subroots")}),
steps AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, level) - 1 AS step, before, after FROM (
    SELECT id, 0 AS part, level, before, after FROM low
    UNION ALL SELECT l.id, 1, h.level, h.before, h.after FROM leaves l JOIN high h ON h.id = l.tree)),
proofs AS (SELECT id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM steps GROUP BY id),
folded AS (
  SELECT id, 0 AS step, altered AS d FROM leaves
  UNION ALL SELECT f.id, f.step + 1, sha256(s.before || f.d || s.after) FROM folded f JOIN steps s ON s.id = f.id AND s.step = f.step),
ends AS (SELECT id, max_by(d, step) AS d FROM folded GROUP BY id)
SELECT l.id AS doc_id, l.d AS leaf, s.d AS subroot, r.d AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
       e.d AS folded_root, e.d = r.d AS verified
FROM leaves l JOIN subroots s ON s.id = l.tree JOIN (SELECT d FROM over_nodes WHERE n = 1) r ON true
JOIN ends e ON e.id = l.id LEFT JOIN proofs p ON p.id = l.id
"""


SQL["op12_merkle_manifest"] = _merkle_sql()


@_query
def op13_secret_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.with_findings(docs, secrets.identifiers(docs)).select("doc_id", "findings")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(joined(F.filter("findings", lambda f: f["kind"] != "novel")), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"))
