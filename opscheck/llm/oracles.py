"""SQL of the operators that can be written as SQL, for a second engine that reads the same tables."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, by the usual table of 256 entries."""
    table = ("list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), "
             "lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))")
    return f"""(SELECT xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''),
        lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t.entries[1 + (xor(c, b) & 255)], c >> 8))) FROM (SELECT {table} AS entries) t)"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR END"


def _reduction(name: str, start: str, levels: int, arity: int = 8) -> str:
    """CTEs that reduce ``start`` (tree, i, digest) level by level; ``<name><k>`` has the nodes of level ``k``."""
    parts = []
    last = start
    for k in range(1, levels + 1):
        parts.append(f"""
    {name}{k} AS (
        SELECT tree, i // {arity} AS i,
               CASE WHEN max(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY i)) ELSE min(digest) END AS digest
        FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {last}) GROUP BY tree, i // {arity})""")
        last = f"{name}{k}"
    return ",".join(parts)


def _siblings(name: str, start: str, levels: int, arity: int = 8) -> str:
    """CTEs with the texts left and right of every node in its run; empty beside an only node."""
    parts = []
    for k in range(levels):
        level = start if k == 0 else f"{name}{k}"
        frame = f"OVER (PARTITION BY tree, i // {arity} ORDER BY i ROWS BETWEEN"
        parts.append(f"""
    {name}_side{k} AS (
        SELECT tree, i, count(*) OVER (PARTITION BY tree) > 1 AS open,
               coalesce(string_agg(digest, '') {frame} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
               coalesce(string_agg(digest, '') {frame} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM {level})""")
    return ",".join(parts)


def merkle(levels: int = 7, top_levels: int = 3) -> str:
    """Proofs of trees of at most 8 ** ``levels`` leaves and 8 ** ``top_levels`` trees."""
    fields = ["doc_id", "source", "lang", "n_chars"]
    own = " || ".join([*map(_field, fields), _field("text")])
    low = " || ".join([*map(_field, fields), _field(
        "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")])
    steps = [("a", k, "s.lang_key", "s.i") for k in range(levels)] + [("t", k, "''", "p.i") for k in range(top_levels)]
    joins, folded, proof = [], "claimed", []
    for name, k, tree, i in steps:
        side = f"{name}{k}"
        joins.append(f"JOIN {name}_side{k} {side} ON {side}.tree = {tree} AND {side}.i = {i} // {8 ** k}")
        proof.append(f"{side}.l || {side}.r")
    folds = []
    for name, k, _, _ in steps:
        side = f"{name}{k}"
        folds.append(f"CASE WHEN {side}_open THEN sha256({side}_l || {folded} || {side}_r) ELSE {folded} END")
        folded = f"f_{side}"
    sides = ", ".join(f"{n}{k}.open AS {n}{k}_open, {n}{k}.l AS {n}{k}_l, {n}{k}.r AS {n}{k}_r" for n, k, _, _ in steps)
    nested = "joined"
    chain = []
    for (name, k, _, _), fold in zip(steps, folds, strict=True):
        chain.append(f"""
    fold_{name}{k} AS (SELECT *, {fold} AS f_{name}{k} FROM {nested})""")
        nested = f"fold_{name}{k}"
    return f"""
WITH leaves AS (
        SELECT doc_id, coalesce('=' || lang, '-') AS lang_key, sha256({own}) AS leaf,
               CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN sha256({low}) ELSE sha256({own}) END AS claimed
        FROM documents),
    s AS (SELECT *, row_number() OVER (PARTITION BY lang_key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
    a0 AS (SELECT lang_key AS tree, i, leaf AS digest FROM s),{_reduction('a', 'a0', levels)},{_siblings('a', 'a0', levels)},
    p AS (SELECT tree AS lang_key, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i FROM a{levels}),
    t0 AS (SELECT '' AS tree, i, subroot AS digest FROM p),{_reduction('t', 't0', top_levels)},{_siblings('t', 't0', top_levels)},
    joined AS (
        SELECT s.doc_id, s.leaf, s.claimed, p.subroot, (SELECT digest FROM t{top_levels}) AS root,
               sha256({' || '.join(proof)}) AS proof_sha256, {sides}
        FROM s JOIN p ON p.lang_key = s.lang_key
        {chr(10).join(joins)}),{','.join(chain)}
SELECT doc_id, leaf, subroot, root, proof_sha256, {folded} AS folded_root, {folded} = root AS verified FROM {nested}
"""


#: Products may pass 64 bits.
COLLOCATIONS = """
WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents),
    lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
    runs AS (
        SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
        FROM lists, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL),
    totals AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 100),
    cuts AS (
        SELECT lang, k, phrase, a, i, array_to_string(ws[1:i], ' ') AS p1, array_to_string(ws[i + 1:], ' ') AS p2
        FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
    scored AS (
        SELECT cuts.lang, cuts.phrase, cuts.k, cuts.a, cuts.i, l.a AS l, r.a AS r, n,
               (1000::HUGEINT * cuts.a * n) // (l.a::HUGEINT * r.a) AS score
        FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = p1 AND l.k = i
        JOIN f r ON r.lang = cuts.lang AND r.phrase = p2 AND r.k = cuts.k - i JOIN totals ON totals.lang = cuts.lang),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
    kept AS (
        SELECT * FROM best b WHERE NOT EXISTS (
            SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.a >= 100 * b.a
            AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""

#: All strings of 50 bytes, the smallest doc_id of each, and the runs of a document's bytes that they cover.
REPEATS = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
    starts AS (SELECT doc_id, b, unnest(range(0, octet_length(b) - 49)) AS p FROM d),
    strings AS (SELECT doc_id, p, b[p + 1:p + 50] AS s FROM starts),
    first AS (SELECT s, min(doc_id) AS least FROM strings GROUP BY s HAVING max(doc_id) > min(doc_id)),
    hits AS (SELECT doc_id, p FROM strings JOIN first USING (s) WHERE least < doc_id),
    breaks AS (
        SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS opens FROM hits),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM breaks),
    runs AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS e FROM numbered GROUP BY doc_id, run),
    kept AS (
        SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS e FROM runs
        UNION ALL
        SELECT d.doc_id, coalesce(max(runs.e), 0), octet_length(any_value(b)) FROM d LEFT JOIN runs ON runs.doc_id = d.doc_id
        GROUP BY d.doc_id),
    texts AS (
        SELECT doc_id, string_agg(hex(b[a + 1:e]), '' ORDER BY a) AS bytes, sum(e - a) AS n_kept
        FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, octet_length(b) AS n_bytes, octet_length(b) - n_kept::BIGINT AS n_removed,
       (SELECT count(*) FROM runs WHERE runs.doc_id = d.doc_id) AS n_spans, lower(sha256(unhex(bytes))) AS kept_sha256
FROM d JOIN texts USING (doc_id)
"""

ORACLES = {"op3_exact_repeats": REPEATS, "op12_collocations": COLLOCATIONS, "op13_merkle_manifest": merkle()}
