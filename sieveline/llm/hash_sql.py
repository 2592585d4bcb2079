"""XXH64 and CRC-32 in SQL by their definitions, the first in unsigned 128-bit arithmetic cut to 64 bits."""

from __future__ import annotations

# The primes of XXH64.
P1 = 11400714785074694791
P2 = 14029467366897019727
P3 = 1609587929392839161
P4 = 9650029242287828579
P5 = 2870177450012600261


def _n(value: int) -> str:
    return f"{value % 2**64}::UHUGEINT"


def _low(x: str) -> str:
    return f"(({x}) & {_n(-1)})"


def _times(x: str, prime: int) -> str:
    return _low(f"({x}) * {_n(prime)}")


def _turn(x: str, bits: int) -> str:
    return _low(f"(({x}) << {bits}) | (({x}) >> {64 - bits})")


def _read(at: str, size: int) -> str:
    """The little-endian number of so many bytes from byte `at` of the hexadecimal text x on."""
    return "CAST('0x' || " + " || ".join(f"substring(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(size))) + " AS UHUGEINT)"


def _numbers(count: str, start: str, step: int, size: int) -> str:
    return f"list_transform(range({count}), lambda i: {_read(f'{start} + {step} * i', size)})"


def _round(acc: str, number: str) -> str:
    return _times(_turn(_low(f"{acc} + {_times(number, P2)}"), 31), P1)


def _lane(k: int, start: int) -> str:
    return f"list_reduce({_numbers('n // 32', str(8 * k), 32, 8)}, lambda v, w: {_round('v', 'w')}, {_n(start)}) AS v{k}"


def _merged() -> str:
    out = _low(" + ".join(_turn(f"v{k}", bits) for k, bits in enumerate((1, 7, 12, 18))))
    for k in range(4):
        out = _low(f"{_times(f'xor({out}, {_round(_n(0), f"v{k}")})', P1)} + {_n(P4)}")
    return out


def _eights() -> str:
    step = f"{_times(_turn(f'xor(h, {_round(_n(0), "w")})', 27), P1)} + {_n(P4)}"
    return f"list_reduce({_numbers('(n % 32) // 8', 'n - n % 32', 8, 8)}, lambda h, w: {_low(step)}, h)"


def _four() -> str:
    mixed = f"xor(h, {_times(_read('n - n % 8', 4), P1)})"
    return f"CASE WHEN n % 8 >= 4 THEN {_low(f'{_times(_turn(mixed, 23), P2)} + {_n(P3)}')} ELSE h END"


def _ones() -> str:
    return f"list_reduce({_numbers('n % 4', 'n - n % 4', 1, 1)}, lambda h, w: {_times(_turn(f'xor(h, {_times("w", P5)})', 11), P1)}, h)"


def _finished(name: str, carry: str) -> str:
    """CTEs from {name}_m(carry, h) to {name}(carry, h)."""
    return f"""{name}_y AS (SELECT {carry}, {_times("xor(h, h >> 33)", P2)} AS h FROM {name}_m),
{name}_z AS (SELECT {carry}, {_times("xor(h, h >> 29)", P3)} AS h FROM {name}_y),
{name} AS (SELECT {carry}, CAST(xor(h, h >> 32) AS UBIGINT) AS h FROM {name}_z)"""


def hashed_texts(name: str, texts: str, seed: int) -> str:
    """CTEs that end in {name}(g, h): the XXH64 of each text g that the query `texts` gives."""
    starts = (seed + P1 + P2, seed + P2, seed, seed - P1)
    lanes = ", ".join(_lane(k, start) for k, start in enumerate(starts))
    return f"""{name}_a AS (SELECT g, hex(encode(g)) AS x, CAST(strlen(g) AS BIGINT) AS n FROM ({texts})),
{name}_b AS (SELECT *, {lanes} FROM {name}_a),
{name}_c AS (SELECT g, x, n, {_low(f"CASE WHEN n >= 32 THEN {_merged()} ELSE {_n(seed + P5)} END + CAST(n AS UHUGEINT)")} AS h FROM {name}_b),
{name}_d AS (SELECT g, x, n, {_eights()} AS h FROM {name}_c),
{name}_e AS (SELECT g, x, n, {_four()} AS h FROM {name}_d),
{name}_m AS (SELECT g, {_ones()} AS h FROM {name}_e),
{_finished(name, "g")}"""


def hashed_number(name: str, source: str, carry: str, number: str, seed: str) -> str:
    """CTEs that end in {name}(carry, h): the XXH64 of a 64-bit number of each row of source, with a seed of the row's own."""
    word = f"CAST((CAST({number} AS HUGEINT) + {2**64}) % {2**64} AS UHUGEINT)"
    return f"""{name}_a AS (SELECT {carry}, CAST({seed} AS UHUGEINT) AS seed, {word} AS w FROM {source}),
{name}_b AS (SELECT {carry}, xor({_low(f"seed + {_n(P5 + 8)}")}, {_round(_n(0), "w")}) AS h FROM {name}_a),
{name}_m AS (SELECT {carry}, {_low(f"{_times(_turn('h', 27), P1)} + {_n(P4)}")} AS h FROM {name}_b),
{_finished(name, carry)}"""


def crc32(text: str) -> str:
    """The CRC-32 of a text's UTF-8 bytes, from the table of the reversed polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    listed = "[" + ", ".join(map(str, table)) + "]::BIGINT[]"
    step = f"xor(c >> 8, ({listed})[(xor(c, b) & 255) + 1])"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: CAST('0x' || b AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: {step}, {2**32 - 1}::BIGINT), {2**32 - 1}::BIGINT)"
