"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ananym.llm import bagminhash, centroids, decontamination, mixing, neardup_vectors, packing, recurrent, repair, rules, sharding, substrings, topk, toxicity

SHARDS = 40
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """A vocabulary file of the public tokenizers installed beside Python, on the driver as on executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_mixing(spark, sf):
    """Per document: the words that the mix takes, and when its copies come, in millionths of the training run (-1: not taken); in order of the first."""
    placed = mixing.curriculum(_table(spark, sf, "documents"), mixing.word_count(), ["doc_id"])
    for name, nth in (("first_position", 1), ("second_position", 2)):
        placed = placed.withColumn(name, F.coalesce(F.floor(F.try_element_at("positions", F.lit(nth)) * 1e6 + 0.5), F.lit(-1)))
    ordered = placed.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")
    return ordered.drop("positions")


def op2_neardup_vectors(spark, sf):
    return neardup_vectors.near_duplicates(_table(spark, sf, "embeddings"))


def op3_sharding(spark, sf):
    return sharding.shard_rows(_table(spark, sf, "documents"), SHARDS)


def op4_substrings(spark, sf):
    kept = substrings.remove_repeats(_table(spark, sf, "documents"))
    words = F.btrim(F.regexp_replace(F.coalesce("kept", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op5_toxicity(spark, sf):
    docs = _table(spark, sf, "documents")
    model = toxicity.fit_severity(docs, _table(spark, sf, "labels"))
    scored = toxicity.score_severity(docs, model, keep=["doc_id"])
    return scored.withColumn("held_out", toxicity.held_out(F.col("doc_id")))


def op6_topk(spark, sf):
    return topk.top_inner_products(_table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_packing(spark, sf):
    pieces = packing.pack(_table(spark, sf, "documents"), tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_bagminhash(spark, sf):
    return bagminhash.near_duplicates(_table(spark, sf, "documents")).drop("h1", "h2")


def op9_recurrent(spark, sf):
    docs = _table(spark, sf, "documents")
    held_out = recurrent.held_out(F.col("doc_id"))
    scored = recurrent.language_scores(docs, ~held_out)
    return scored.withColumn("held_out", recurrent.held_out(F.col("doc_id")))


def op10_rules(spark, sf):
    docs = _table(spark, sf, "documents")
    scored = rules.score_quality(docs, rules.fit_quality(docs, _table(spark, sf, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_decontamination(spark, sf):
    return decontamination.contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op12_centroids(spark, sf):
    return centroids.cluster(_table(spark, sf, "embeddings"))


def op13_repair(spark, sf):
    return repair.repair(_table(spark, sf, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op2_neardup_vectors": op2_neardup_vectors, "op3_sharding": op3_sharding, "op4_substrings": op4_substrings, "op5_toxicity": op5_toxicity, "op6_topk": op6_topk, "op7_packing": op7_packing, "op8_bagminhash": op8_bagminhash, "op9_recurrent": op9_recurrent, "op10_rules": op10_rules, "op11_decontamination": op11_decontamination, "op12_centroids": op12_centroids, "op13_repair": op13_repair}


_OP2 = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors AS a JOIN vectors AS b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.98
),
reached AS (SELECT a AS node, a AS root FROM links UNION SELECT links.b, root FROM reached JOIN links ON a = node),
roots AS (SELECT node, min(root) AS root FROM reached GROUP BY node),
counts AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN roots ON vec_id = roots.node LEFT JOIN counts ON vec_id = counts.node"""
_OP6 = """
WITH points AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(q.x, p.x)::BIGINT AS score
  FROM points AS q JOIN points AS p ON q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10"""


_WORD = r"'[^\x20\x09-\x0D]+'"


def _demand_sql(begin: str) -> str:
    """When a source's demand, the integral of its weight schedule, reaches a copy that begins after ``begin`` of its words."""

    def inverse(schedule: tuple[float, ...]) -> str:
        step, done, pieces = 1 / (len(schedule) - 1), 0.0, []
        areas = [step * (a + b) / 2 for a, b in zip(schedule, schedule[1:])]
        for i, (a, b) in enumerate(zip(schedule, schedule[1:])):
            y = f"(({begin} / target) - {done / sum(areas)!r}e0) * {sum(areas)!r}e0"
            root = f"{a!r}e0 + sqrt(greatest(0e0, {a * a!r}e0 + {2 * (b - a) / step!r}e0 * ({y})))"
            done += areas[i]
            until = f"WHEN ({begin} / target) < {done / sum(areas)!r}e0 THEN" if i < len(areas) - 1 else "ELSE"
            pieces.append(f"{until} {i * step!r}e0 + CASE WHEN ({y}) <= 0 THEN 0e0 ELSE 2e0 * ({y}) / ({root}) END")
        return f"least(1e0, greatest(0e0, CASE {' '.join(pieces)} END))"

    places = " ".join(f"WHEN {i} THEN {inverse(s)}" for i, s in enumerate(mixing.SCHEDULES))
    return f"floor((CASE place % {len(mixing.SCHEDULES)} {places} END) * 1e6 + 0.5e0)::BIGINT"


_OP1 = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::BIGINT AS size, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS place
  FROM documents
),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth, nth % 3 AS place,
         [5.0, 2.0, 1.0][(nth % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source
),
levels AS (SELECT *, 2 * source_size / weight AS level FROM sources),
reached AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach
  FROM levels
),
targets AS (
  SELECT source, source_size, place,
         CASE WHEN level <= reach THEN (2 * source_size)::DOUBLE
              ELSE weight * (SELECT reach FROM reached WHERE level > reach ORDER BY level, source NULLS LAST LIMIT 1) END AS target
  FROM reached
),
placed AS (
  SELECT doc_id, source, size, (sum(size) OVER (PARTITION BY source ORDER BY place, size, doc_id ROWS UNBOUNDED PRECEDING) - size)::DOUBLE AS before FROM sized
),
copies AS (
  SELECT *, size > 0 AND before + size / 2 < target AS first, size > 0 AND source_size + before + size / 2 < target AS second
  FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, (size * (first::INT + second::INT))::BIGINT AS taken,
       CASE WHEN first THEN {_demand_sql("before")} ELSE -1 END AS first_position,
       CASE WHEN second THEN {_demand_sql("(before + source_size)")} ELSE -1 END AS second_position
FROM copies"""
_OP4 = f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
windows AS (SELECT doc_id, s, list_slice(w, s, s + 19) AS words FROM texts, unnest(generate_series(1, len(w) - 19)) AS g(s) WHERE len(w) >= 20),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY words ORDER BY doc_id, s) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM later, range(20) AS r(i)),
removed AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM texts LEFT JOIN removed USING (doc_id)"""
_OP8 = f"""
WITH RECURSIVE classes AS (SELECT text, min(doc_id) AS id, any_value(regexp_extract_all(text, {_WORD})) AS w FROM documents WHERE text IS NOT NULL GROUP BY text),
shingles AS MATERIALIZED (
  SELECT id, shingle, count(*) AS n FROM (
    SELECT id, array_to_string(list_slice(w, s, s + 4), ' ') AS shingle FROM classes, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS g(s) WHERE len(w) > 0
  ) GROUP BY id, shingle
),
sizes AS (SELECT id, sum(n) AS n FROM shingles GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS n FROM shingles AS a JOIN shingles AS b ON a.shingle = b.shingle AND a.id <> b.id GROUP BY a.id, b.id),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes AS x ON x.id = a JOIN sizes AS y ON y.id = b WHERE shared.n >= 0.8 * (x.n + y.n - shared.n)
),
reached AS (SELECT a AS node, a AS root FROM links UNION SELECT links.b, root FROM reached JOIN links ON a = node),
roots AS (SELECT node, min(root) AS root FROM reached GROUP BY node)
SELECT doc_id, coalesce(id, doc_id) AS class_id, coalesce(root, id, doc_id) AS component_id, coalesce(root, id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN classes USING (text) LEFT JOIN roots ON id = node"""

_OP11 = r"""
WITH texts AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark),
split AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
),
windows AS (
  SELECT id AS item_id, n, list_slice(w, s, s + n - 1) AS words
  FROM (SELECT id, w, least(len(w), 10) AS n FROM split WHERE kind = 'item' AND len(w) > 0), unnest(generate_series(1, len(w) - n + 1)) AS g(s)
),
places AS (
  SELECT id AS doc_id, s, n, list_slice(w, s, s + n - 1) AS words
  FROM split JOIN (SELECT DISTINCT n FROM windows) ON kind = 'document' AND len(w) >= n, unnest(generate_series(1, len(w) - n + 1)) AS g(s)
),
found AS (SELECT doc_id, s, places.n AS n, item_id FROM places JOIN windows USING (words)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS place FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN hit ON id = hit.doc_id LEFT JOIN named ON id = named.doc_id WHERE kind = 'document'"""

_NEAREST = """
  SELECT id, any_value(q) AS q, min(struct_pack(distance := distance, cluster := cluster)) AS best FROM (
    SELECT v.id, v.q, c.cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
    FROM vectors AS v JOIN {centroids} AS c ON true
  ) GROUP BY id"""
_MEANS = """
  SELECT cluster, coalesce(moved.q, c.q) AS q FROM {centroids} AS c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS q FROM (
      SELECT best.cluster AS cluster, i, sum(q[i]) AS s, count(*) AS n FROM {assigned}, range(1, 65) AS g(i) GROUP BY best.cluster, i
    ) GROUP BY cluster
  ) AS moved USING (cluster)"""
_ROUNDS = "".join(
    f",\nassigned{i} AS MATERIALIZED ({_NEAREST.format(centroids=f'centroids{i}')}\n)"
    + (f",\ncentroids{i + 1} AS MATERIALIZED ({_MEANS.format(centroids=f'centroids{i}', assigned=f'assigned{i}')}\n)" if i < 3 else "")
    for i in range(4)
)
_OP12 = f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
centroids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, q) - 1 AS cluster, q FROM vectors QUALIFY cluster < 16
){_ROUNDS}
SELECT vec_id, best.cluster::INT AS cluster, best.distance AS distance, (sum(best.distance) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia,
       (sum(best.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(centroids3.q::VARCHAR[], ',')) AS centroid_sha256
FROM assigned3 JOIN vectors USING (id) JOIN centroids3 ON centroids3.cluster = best.cluster"""

_PUT = "struct_pack(cost := {best}.cost + {cost}, audit := {best}.audit || '{edit}', out := CASE WHEN {best}.out = '' THEN '' ELSE {best}.out || chr(10) END || {row})"
_WANTED = "CASE {state} WHEN 'u' THEN 'assistant' ELSE 'user' END"
_INSERTED = _PUT.format(best="best", cost=3, edit="I", row=f"{_WANTED.format(state='state')} || ':'")
_NEXT = "CASE {state} WHEN 'u' THEN 'a' ELSE 'u' END"
_OP13 = rf"""
WITH RECURSIVE
kinds AS (
  SELECT *, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(string_split(conv_id || ':' || turn, ''), lambda c: ord(c)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))
         )) % 20 AS kind
  FROM conversations
),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS copies(i)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final
  FROM damaged
),
rows AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, left(role, 1) AS initial, CASE WHEN final = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM placed
),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, state, best FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES
    ('', struct_pack(cost := 0::BIGINT, audit := '', out := '')),
    ('u', struct_pack(cost := 3::BIGINT, audit := 'I', out := 'user:')),
    ('a', struct_pack(cost := 6::BIGINT, audit := 'II', out := 'user:' || chr(10) || 'assistant:'))) AS first(state, best)
  UNION ALL
  SELECT conv_id, i, state, min(best) FROM (
    SELECT conv_id, i, CASE WHEN again THEN {_NEXT.format(state="state")} ELSE state END AS state,
           CASE WHEN again THEN {_INSERTED} ELSE best END AS best
    FROM (
      SELECT conv_id, i, CASE WHEN once THEN {_NEXT.format(state="state")} ELSE state END AS state, CASE WHEN once THEN {_INSERTED} ELSE best END AS best, once
      FROM (
        SELECT ways.conv_id, rows.i AS i,
               CASE edit WHEN 'D' THEN state WHEN 'R' THEN {_NEXT.format(state="state")} ELSE initial END AS state,
               CASE edit WHEN 'D' THEN struct_pack(cost := best.cost + 4, audit := best.audit || 'D', out := best.out)
                         WHEN 'R' THEN {_PUT.format(best="best", cost="3 + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END", edit="R", row=f"{_WANTED.format(state='state')} || ':' || text")}
                         ELSE {_PUT.format(best="best", cost="CASE fault WHEN 'truncated' THEN 3 ELSE 0 END", edit="K", row="role || ':' || text")} END AS best
        FROM ways JOIN rows ON rows.conv_id = ways.conv_id AND rows.i = ways.i + 1, (VALUES ('D'), ('R'), ('K')) AS edits(edit)
        WHERE edit = 'D' OR fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR state || '>' || initial IN ('>s', '>u', 's>u', 'u>a', 'a>u'))
      ), (VALUES (false), (true)) AS one(once)
    ), (VALUES (false), (true)) AS two(again) WHERE once OR NOT again
  ) GROUP BY conv_id, i, state
),
totals AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
),
best AS (
  SELECT ways.conv_id, min(best) AS best FROM ways LEFT JOIN totals USING (conv_id) WHERE ways.i = coalesce(n, 0) AND state IN ('', 'a') GROUP BY ways.conv_id
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
       sha256(best.out) AS repaired_sha256
FROM best LEFT JOIN totals USING (conv_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": _OP1, "op2_neardup_vectors": _OP2, "op4_substrings": _OP4, "op6_topk": _OP6, "op8_bagminhash": _OP8, "op11_decontamination": _OP11, "op12_centroids": _OP12, "op13_repair": _OP13}
