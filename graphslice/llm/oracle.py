"""Plain SQL of the text queries that SQL can express, run by DuckDB on the same tables."""

from __future__ import annotations

#: crc32 (reflected polynomial) of the characters of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda r, c: list_reduce(list_prepend(xor(r, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                          lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""

# Sixteen to the sixth documents of a source, and sixteen to the fourth sources, are the most the SQL can take.
_HEIGHT, _TOP_HEIGHT = 6, 4


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


def _tree(name: str, height: int) -> list[str]:
    """Levels ``name0 .. name<height>`` above the rows ``name0 (key, idx, total, digest)``."""
    return [
        f"""{name}{k + 1} AS MATERIALIZED (
            SELECT key, idx // 16 AS idx, (max(total) + 15) // 16 AS total,
                   list(digest ORDER BY idx) AS children, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
            FROM {name}{k} WHERE total > 1 GROUP BY key, idx // 16)"""
        for k in range(height)
    ]


def _folds(name: str, height: int, into: str) -> list[str]:
    """``into0 (row, key, idx, now, proof)`` folded level by level; a key that has no more levels stays as it is."""
    return [
        f"""{into}{k + 1} AS MATERIALIZED (
            SELECT f.row, f.key, f.idx // 16 AS idx,
                   CASE WHEN t.key IS NULL THEN f.now ELSE sha256(array_to_string(
                       t.children[1:f.idx % 16] || [f.now] || t.children[f.idx % 16 + 2:], '')) END AS now,
                   f.proof || CASE WHEN t.key IS NULL THEN '' ELSE array_to_string(
                       t.children[1:f.idx % 16] || t.children[f.idx % 16 + 2:], '') END AS proof
            FROM {into}{k} f LEFT JOIN {name}{k + 1} t ON t.key = f.key AND t.idx = f.idx // 16)"""
        for k in range(height)
    ]


def _ends(name: str, height: int) -> str:
    return " UNION ALL ".join(f"SELECT key, digest FROM {name}{k} WHERE total = 1" for k in range(height + 1))


def manifest_sql() -> str:
    crc = _CRC.format("doc_id")
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""leaves AS MATERIALIZED (
            SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, '') AS key, {_leaf('text')} AS leaf,
                   CASE WHEN {crc} % 5 = 0 THEN {_leaf(lowered)} ELSE {_leaf('text')} END AS now
            FROM documents)""",
        """placed AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS idx,
                   count(*) OVER (PARTITION BY key) AS total FROM leaves)""",
        "doc0 AS MATERIALIZED (SELECT key, idx, total, leaf AS digest FROM placed)",
        *_tree("doc", _HEIGHT),
        f"subroots AS MATERIALIZED ({_ends('doc', _HEIGHT)})",
        """top0 AS MATERIALIZED (
            SELECT 0 AS key, row_number() OVER (ORDER BY encode(key)) - 1 AS idx, count(*) OVER () AS total, digest,
                   key AS name FROM subroots)""",
        *_tree("top", _TOP_HEIGHT),
        f"root AS MATERIALIZED (SELECT digest AS root FROM ({_ends('top', _TOP_HEIGHT)}))",
        "fold0 AS MATERIALIZED (SELECT row, key, idx, now, '' AS proof FROM placed)",
        *_folds("doc", _HEIGHT, "fold"),
        f"""up0 AS MATERIALIZED (
            SELECT f.row, t.key, t.idx, f.now, f.proof FROM fold{_HEIGHT} f JOIN top0 t ON t.name = f.key)""",
        *_folds("top", _TOP_HEIGHT, "up"),
    ]
    return f"""WITH {", ".join(parts)}
        SELECT p.doc_id, p.leaf, s.digest AS subroot, r.root, sha256(u.proof) AS proof_sha256, u.now AS folded_root,
               u.now = r.root AS verified
        FROM placed p JOIN subroots s ON s.key = p.key JOIN up{_TOP_HEIGHT} u ON u.row = p.row CROSS JOIN root r"""


#: Fixed values, those of the query: rules as name, host, path and verdict, longest first, and labels of listed hosts.
_RULES = [
    ("example.com/de/", "example.com", "/de/", "block"),
    ("example.net/en/", "example.net", "/en/", "allow"),
    ("org/fr/", "org", "/fr/", "allow"),
    ("net/", "net", "/", "block"),
]
_LABELS = ["spam-farm", "cheap-pills", "free-bets", "casino-win", "ads-track", "adult-x"]


def url_sql() -> str:
    cases = {
        pick: " ".join(
            f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{value}'"
            for name, host, path, verdict in _RULES
            for value in [{"rule": name, "verdict": verdict}[pick]]
        )
        for pick in ("rule", "verdict")
    }
    return rf"""WITH parts AS (
            SELECT page_id, coalesce(instr(url, '://') > 0, false) AS whole,
                   CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        named AS (
            SELECT page_id, whole,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                   list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda p:
                       p <> '' AND NOT regexp_matches(p, '^(?i)(utm_[^=&]*|ref|fbclid|gclid)(=.*)?$')) AS kept
            FROM parts),
        canon AS (
            SELECT *, CASE WHEN whole THEN regexp_replace(host, '^www\.|\.?(:80|:443)?$', '', 'g')
                       || regexp_replace(path, '/+$', '', 'g')
                       || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END END AS canon
            FROM named),
        listed AS (SELECT DISTINCT canon FROM canon WHERE list_has_any(string_split(host, '.'), {_LABELS}))
        SELECT page_id, host, path, CASE {cases['rule']} END AS rule,
               CASE {cases['verdict']} WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict
        FROM canon"""


def _quotients(name: str, parties: str, group: str, key: str, weight: str) -> list[str]:
    """``<name>``: the rows of ``parties`` with ``quota``, their seats by highest quotients within ``group``."""
    share = lambda m: f"CAST(floor(coalesce({weight} * ({m}) / nullif(total, 0), 0) + 0.5) AS BIGINT)"
    return [
        f"""{name}_sums AS MATERIALIZED (
            SELECT *, count(*) OVER (PARTITION BY {group}) / 2.0 AS half, sum({weight}) OVER (PARTITION BY {group}) AS total
            FROM {parties})""",
        f"""{name}_bounds AS MATERIALIZED (
            SELECT *, greatest(0, {share("seats - half")} - 1) AS fewest, {share("seats + half")} + 1 AS most
            FROM {name}_sums)""",
        f"""{name}_open AS MATERIALIZED (
            SELECT *, seats - sum(fewest) OVER (PARTITION BY {group}) AS open FROM {name}_bounds)""",
        f"""{name}_each AS MATERIALIZED (
            SELECT {group} AS g, {key} AS k, open, {weight} AS w, unnest(range(fewest + 1, most + 1)) AS nth FROM {name}_open)""",
        f"""{name}_won AS MATERIALIZED (
            SELECT g, k, count(*) AS won FROM (
                SELECT *, row_number() OVER (PARTITION BY g ORDER BY w / (nth - 0.5) DESC, k, nth) AS place FROM {name}_each)
            WHERE place <= open AND w > 0 GROUP BY g, k)""",
        f"""{name} AS MATERIALIZED (
            SELECT o.*, fewest + coalesce(won, 0) AS quota FROM {name}_open o
            LEFT JOIN {name}_won ON g = o.{group} AND k = o.{key})""",
    ]


def _drawn(text: str) -> str:
    return f"CAST('0x' || md5({text})[1:8] AS BIGINT)"


def mix_sql(seed: int = 7, block: int = 16, shard_rows: int = 4096, repeats: int = 3) -> str:
    chosen = lambda place: (
        f"(greatest(0, least({place}, last) - first) + greatest(0, least({place}, last - blocks * {block})))"
    )
    parts = [
        f"""rows0 AS MATERIALIZED (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
                   md5(concat_ws('|', '{seed}', doc_id, text)) AS mark
            FROM documents)""",
        """ranked AS MATERIALIZED (
            SELECT source, sum(size) AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
            FROM rows0 GROUP BY source)""",
        f"""weighed AS MATERIALIZED (
            SELECT *, [5, 2, 1][sid % 3 + 1] AS weight, source_size * {repeats} AS ceiling FROM ranked)""",
        """levels AS MATERIALIZED (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER (
                           ORDER BY ceiling / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                       / sum(weight) OVER (ORDER BY ceiling / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM weighed)""",
        """sources AS MATERIALIZED (
            SELECT *, CAST(CASE WHEN ceiling / weight >= level
                                THEN weight * max(CASE WHEN ceiling / weight >= level THEN level END) OVER ()
                                ELSE ceiling END AS DOUBLE) AS target
            FROM levels)""",
        f"""parties AS MATERIALIZED (
            SELECT sid, target, 0 AS everyone, CAST(round(sum(target) OVER () / {block}) AS BIGINT) AS seats FROM sources)""",
        *_quotients("quotas", "parties", "everyone", "sid", "target"),
        f"""placed AS MATERIALIZED (
            SELECT r.doc_id, r.source, r.mark, r.size, s.source_size, s.target, s.sid,
                   CAST('0x' || r.mark[1:8] AS BIGINT) % CAST(ceil(s.n / {shard_rows}) AS BIGINT) AS shard
            FROM rows0 r JOIN sources s ON r.source IS NOT DISTINCT FROM s.source)""",
        """shards AS MATERIALIZED (
            SELECT p.sid, p.shard, sum(p.size) AS words, any_value(q.quota) AS seats
            FROM placed p JOIN quotas q ON q.sid = p.sid GROUP BY p.sid, p.shard)""",
        *_quotients("shares", "shards", "sid", "shard", "words"),
        f"""blocks AS MATERIALIZED (
            SELECT sid, shard, blocks, least(quota, blocks * {repeats}) AS quota,
                   {_drawn(f"concat_ws('|', '{seed}', sid, shard)")} % blocks * {block} AS first
            FROM (SELECT *, greatest(CAST(ceil(words / {block}) AS BIGINT), 1) AS blocks FROM shares))""",
        f"""laid AS MATERIALIZED (
            SELECT p.*, b.blocks, b.quota, b.first, b.first + b.quota % b.blocks * {block} AS last,
                   sum(size) OVER (PARTITION BY p.sid, p.shard ORDER BY mark, size ROWS UNBOUNDED PRECEDING) AS upto
            FROM placed p JOIN blocks b ON b.sid = p.sid AND b.shard = p.shard)""",
    ]
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
               CAST(quota // blocks * size + {chosen("upto")} - {chosen("upto - size")} AS BIGINT) AS taken, source
        FROM laid"""


ORACLE: dict[str, str] = {
    "op6_sainte_lague_mix": mix_sql(),
    "op10_url_filter": url_sql(),
    "op11_midstate_manifest": manifest_sql(),
}
