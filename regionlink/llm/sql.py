"""Mixing and sharding in DuckDB's SQL, for the driver's comparison; values from the operators' own parameters."""

from __future__ import annotations

from .source_mixing import _PRIME, _ROUNDS

_SOURCE = "CASE WHEN source IS NULL THEN '1' ELSE '0' || source END"


def _hash(seed: int) -> str:
    return f"md5('{seed}|' || coalesce(doc_id::VARCHAR, '~') || '|' || coalesce(md5(text), '~'))"


def mixing_sql(block: int = 64, seed: int = 4, n_shards: int = 8) -> str:
    by_shard = ", ".join(f"coalesce(sum(times * words) FILTER (shard = {k}), 0)::BIGINT" for k in range(n_shards))
    rounds = []
    for r in range(_ROUNDS):
        a, b, k = (pow(g, r + 2, _PRIME) for g in (48_271, 69_621, 16_807))
        rounds.append(
            f"r{r + 1} AS (SELECT source, n, shard, tweak, CASE WHEN ((({a} * ((greatest(x, o) + key) % {_PRIME}) + {b}) % {_PRIME}) >> 12) % 2 = 1 THEN o ELSE x END AS x "
            f"FROM (SELECT *, ((key - x) % n + n) % n AS o FROM (SELECT *, ({k} * ((tweak + 1) % {_PRIME})) % {_PRIME} AS key FROM r{r})))"
        )
    return rf"""
WITH d AS (SELECT doc_id, {_SOURCE} AS source, {_hash(seed)} AS h, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS place,
        coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source) - 1) % 3 + 1]::DOUBLE AS w, source_size::DOUBLE * 2 AS cap, sum(source_size) OVER ()::DOUBLE * 1.5 AS total FROM s),
l AS (SELECT *, cap / w AS ratio, (total - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM w
      WINDOW b AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source LIMIT 1), 'inf'::DOUBLE) * w) AS target FROM l),
k AS (SELECT source, n, CASE WHEN target >= source_size * 2 THEN 2 * n ELSE least(round(target / {block})::BIGINT, 2 * n) END AS slots
      FROM (SELECT *, ceil(source_size / {block})::BIGINT AS n FROM t WHERE source_size > 0)),
drawn AS (SELECT source, n, ('0x' || substr(md5('{seed}|' || source || '|' || draw), 1, 8))::BIGINT % {n_shards} AS shard, count(*) AS count
          FROM (SELECT source, n, unnest(range(slots)) AS draw FROM k) GROUP BY ALL),
numbered AS (SELECT *, coalesce(sum(count) OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM drawn),
r0 AS (SELECT source, n, shard, (slot // n) * 7919 + {seed} AS tweak, slot % n AS x FROM (SELECT source, n, shard, first + unnest(range(count)) AS slot FROM numbered)),
{", ".join(rounds)},
hits AS (SELECT source, shard, x AS block, count(*) AS times FROM r{_ROUNDS} GROUP BY ALL),
p AS (SELECT source, place, before, size, unnest(range(before // {block}, (before + size - 1) // {block} + 1)) AS block FROM o WHERE size > 0),
taken AS (SELECT source, place, sum(times * words) AS taken, concat_ws(',', {by_shard}) AS taken_by_shard
          FROM (SELECT *, least(before + size, (block + 1) * {block}) - greatest(before, block * {block}) AS words FROM p) JOIN hits USING (source, block) GROUP BY ALL)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(taken_by_shard, '{",".join("0" * n_shards)}') AS taken_by_shard
FROM o JOIN t USING (source) LEFT JOIN taken USING (source, place)
"""


def sharding_sql(n_shards: int = 8, seed: int = 5) -> str:
    def shifted(x: int) -> int:
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        return x

    nibbles = [shifted(i) for i in range(16)]
    step = lambda c: f"xor({c} >> 4, {nibbles}[({c} & 15) + 1]::BIGINT)"
    crc = f"xor(list_reduce(list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda p: ('0x' || p)::BIGINT), lambda c, b: {step(step('xor(c, b)'))}, 4294967295::BIGINT), 4294967295::BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, {_SOURCE} AS source, {_hash(seed)} AS h, strlen(coalesce(text, ''))::BIGINT + 1 AS size, {crc} AS text_crc32 FROM documents),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1) / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS fraction, count(*) OVER () AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, source, h, doc_id) - 1 AS position FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position * {n_shards} // n)::INTEGER AS shard,
       (position - ((position * {n_shards} // n) * n + {n_shards - 1}) // {n_shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p
"""


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
d AS (SELECT doc_id, CASE WHEN coalesce(len(words), 0) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(len(words) - 4, 1)), lambda i: array_to_string(words[i + 1:i + 5], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM d),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n + b.n) AS n FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 75 * (n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM d JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""
