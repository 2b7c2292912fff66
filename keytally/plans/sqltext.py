"""Pieces of the SQL that the queries' results are checked against."""

from __future__ import annotations

from keytally.functions.seeds import SeedTable, draw_seeds

M31 = 2147483647
M32 = 4294967295
ODD = 2863311530

TOKENS = (
    "(SELECT key, 1::BIGINT AS weight FROM (SELECT unnest(string_split_regex(lower(text), "
    "'[^\\p{L}\\p{N}]+')) AS key FROM documents) WHERE key <> '')"
)


def stream(table: str, key: str, weight: str = "1", extra: str = "") -> str:
    more = f", {extra}" if extra else ""
    return f"(SELECT {key} AS key, ({weight})::BIGINT AS weight{more} FROM {table})"


def hist(source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return (
        f"(SELECT {lead}key, SUM(weight)::BIGINT AS cnt FROM {source} GROUP BY {lead}key)"
    )


def fold(x: str) -> str:
    return f"xor(({x})::BIGINT & {M31}, (({x})::BIGINT >> 31) & {M31})"


def h31(a: str, b: str, x: str) -> str:
    r = f"(({a})::BIGINT * ({x}) + ({b})::BIGINT)"
    return f"((({r} >> 31) + {r}) & {M31})"


def four(a: str, b: str, c: str, d: str, x: str) -> str:
    """Nested three deep; each level is repeated twice in the text, which stays short enough."""
    return h31(h31(h31(a, b, x), c, x), d, x)


def sign(h: str) -> str:
    return f"((({h}) & 1) * 2 - 1)"


def bucket(buckets: int, x: str = "x", lead: str = "h") -> str:
    return f"({four(f's.{lead}a', f's.{lead}b', f's.{lead}c', f's.{lead}d', x)} % {buckets})"


def sketch(
    source: str,
    seeds: SeedTable,
    buckets: int,
    signed: bool = False,
    by: str = "",
    ids: str = '"row"',
    x: str | None = None,
) -> str:
    """Cells of a linear sketch."""
    lead = f"{by}, " if by else ""
    amount = f"{sign(four('s.sa', 's.sb', 's.sc', 's.sd', 'x'))} * weight" if signed else "weight"
    folded = fold("key") if x is None else x
    ids = ", ".join(f"s.{i.strip()}" for i in ids.split(","))
    return (
        f"(SELECT {lead}{ids}, {bucket(buckets)} AS bucket, SUM({amount})::BIGINT AS v "
        f"FROM (SELECT *, {folded} AS x FROM {source}), {seeds.values_sql()} GROUP BY ALL)"
    )


def cells_of(probes: str, seeds: SeedTable, buckets: int, cols: str = "key") -> str:
    """Each probe once per sketch row with its bucket."""
    return (
        f'(SELECT {cols}, s."row", {bucket(buckets)} AS bucket '
        f"FROM (SELECT *, {fold('key')} AS x FROM {probes}), {seeds.values_sql()})"
    )


def count_min_est(cells: str, probes: str, seeds: SeedTable, buckets: int) -> str:
    """(key, est) per distinct probe key."""
    return (
        "(SELECT key, MIN(COALESCE(v, 0))::BIGINT AS est FROM "
        f'{cells_of(probes, seeds, buckets)} p LEFT JOIN {cells} c USING ("row", bucket) '
        "GROUP BY key)"
    )


def row_hash(row_id: str, seed: int) -> str:
    a, b, c, d, e = draw_seeds(5, seed)
    low = four(a, b, c, d, f"(({row_id})::BIGINT & {M31})")
    return h31(e, low, f"((({row_id})::BIGINT >> 31) & {M31})")


def wide_hash(row_id: str, seed: int) -> str:
    """Two hashes from one run of ten seeds, as one 62-bit number."""
    seeds = draw_seeds(10, seed)
    low = four(*map(str, seeds[5:9]), f"(({row_id})::BIGINT & {M31})")
    low = h31(seeds[9], low, f"((({row_id})::BIGINT >> 31) & {M31})")
    return f"({row_hash(row_id, seed)} * 2147483648 + {low})"


def uniform(row_id: str, seed: int) -> str:
    return f"(({row_hash(row_id, seed)} + 0.5::DOUBLE) / 2147483648::DOUBLE)"


def row_index(row_id: str, seed: int) -> str:
    """A dense index in the order of the hash, to be used as a window expression."""
    return f"(row_number() OVER (ORDER BY {row_hash(row_id, seed)}, {row_id}) - 1)"
