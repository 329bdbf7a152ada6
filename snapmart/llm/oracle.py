"""SQL texts of the operators whose results SQL can state, in DuckDB's dialect."""

from __future__ import annotations

from snapmart.llm import sharding
from snapmart.llm.merkle import FIELDS

#: Levels written out: enough for 8 ** LEVELS rows of a group.
LEVELS = 7


def crc32(blob: str) -> str:
    """Unsigned CRC-32 of a blob, bit by bit: a byte goes in, then eight shifts (-1)."""
    byte = "[CAST(concat('0x', h) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]"
    steps = f"flatten(list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: {byte}))"
    shift = "xor(c >> 1, 3988292384 * (c & 1))"
    return (
        f"xor(list_reduce(list_prepend(4294967295, {steps}), "
        f"lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE {shift} END), 4294967295)"
    )


def merkle() -> str:
    """Leaves, levels of eight, and each row's path and fold, level by level."""
    def leaf(text: str) -> str:
        fields = [text if f == "text" else f for f in FIELDS]
        return "sha256(concat(" + ", ".join(
            f"CASE WHEN {f} IS NULL THEN '-' ELSE concat(strlen(CAST({f} AS VARCHAR)), ':', CAST({f} AS VARCHAR)) END"
            for f in fields
        ) + "))"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tampered = f"{crc32('encode(CAST(doc_id AS VARCHAR))')} % 3 = 0"
    parts = [f"""
        leaves AS (
            SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE concat('=', lang) END AS g, {leaf('text')} AS leaf,
                CASE WHEN {tampered} THEN {leaf(lower)} END AS claimed
            FROM documents
        ),
        t0 AS (
            SELECT doc_id, leaf, coalesce(claimed, leaf) AS claimed,
                g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
            FROM leaves
        ),
        a0 AS (SELECT g, pos, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM t0)
    """]
    parts += _climb("a", "g", LEVELS)
    parts.append(f"""
        b0 AS (
            SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, digest, count(*) OVER () AS n, g AS name
            FROM a{LEVELS} WHERE pos = 0
        )
    """)
    parts += _climb("b", "g", 3)
    cur, proof, joins = "t.claimed", [], []
    for kind, depth, group, at in (("a", LEVELS, "t.g", "t.pos"), ("b", 3, "''", "s.pos")):
        for level in range(depth):
            name = f"{kind}{level}s"
            joins.append(f"JOIN {name} ON {name}.g = {group} AND {name}.pos = {at} // {8 ** level}")
            proof += [f"{name}.early", f"{name}.late"]
            cur = f"CASE WHEN {name}.n = 1 THEN {cur} ELSE sha256(concat({name}.early, {cur}, {name}.late)) END"
            joins.append(f"CROSS JOIN LATERAL (SELECT {cur} AS f) AS {name}f")
            cur = f"{name}f.f"
        if kind == "a":
            joins.append("JOIN b0 AS s ON s.name = t.g")
    return f"""
        WITH {', '.join(parts)}
        SELECT t.doc_id, t.leaf, s.digest AS subroot, r.digest AS root,
            sha256(concat({', '.join(proof)})) AS proof_sha256,
            {cur} AS folded_root, {cur} = r.digest AS verified
        FROM t0 AS t {' '.join(joins)} CROSS JOIN (SELECT digest FROM b3 WHERE pos = 0) AS r
    """


def _climb(kind: str, group: str, depth: int) -> list[str]:
    """Each level with the digests beside a node inside its run, and the level above."""
    out = []
    for level in range(depth):
        low, run = f"{kind}{level}", f"OVER (PARTITION BY {group}, pos // 8 ORDER BY pos ROWS BETWEEN"
        out.append(f"""
            {low}s AS (SELECT g, pos, n,
                CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS early,
                CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS late
                FROM {low})
        """)
        out.append(f"""
            {kind}{level + 1} AS (SELECT g, pos // 8 AS pos, (max(n) + 7) // 8 AS n,
                CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
                FROM {low} GROUP BY g, pos // 8)
        """)
    return out


def shards(tree: list, grown: list) -> str:
    """Three draws a row and tree, then the slots."""
    def descent(name: str, leaves: list) -> str:
        out, source, at = [], "d", "''"
        for level, nodes in enumerate(sharding.levels(leaves)):
            rows = ", ".join(f"('{p}', '{c}', {w:e})" for p, children in nodes.items() for c, w in children.items())
            step = f"{name}{level}"
            hashed = f"CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', child)), 1, {sharding.DIGITS})) AS BIGINT)"
            draw = f"-ln((CAST({hashed} AS DOUBLE) + 0.5) / {float(16**sharding.DIGITS)!r}) / weight"
            out.append(
                f"{step} AS (SELECT doc_id, arg_min(child, {draw}) AS pos FROM {source} "
                f"JOIN (VALUES {rows}) AS v(parent, child, weight) ON parent = {at} GROUP BY doc_id)"
            )
            source, at = step, "pos"
        return ", ".join(out)

    return f"""
        WITH d AS (SELECT doc_id, text FROM documents), {descent('x', tree)}, {descent('y', grown)},
        both_ AS (SELECT doc_id, CAST(split_part(x2.pos, '/', 3) AS INTEGER) AS shard,
                      CAST(split_part(y2.pos, '/', 3) AS INTEGER) AS grown_shard FROM x2 JOIN y2 USING (doc_id))
        SELECT doc_id, CAST(strlen(coalesce(text, '')) + {sharding.ROW_BYTES} AS BIGINT) AS size,
            {crc32("encode(coalesce(text, ''))")} AS text_crc32, 'key' AS law, shard,
            row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
        FROM d JOIN both_ USING (doc_id)
    """
