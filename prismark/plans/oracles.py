"""The generators again, in DuckDB's SQL: BLAKE3, XXH32, content-defined chunks, MinHash, SimHash and base32.

Nothing here is shared with the kernels but the published constants, so equal results mean equal algorithms. Words of 32
bits are UBIGINT: a product of two fits, and ``x * (2^32 + 1)`` holds x twice, from which any rotation is cut out.
"""

from __future__ import annotations

from prismark.tables import MERSENNE, MINHASH_A, MINHASH_B, gear

MASK, TWICE = 4294967295, 4294967297
# Fixed values of BLAKE3: the start values, and where each round takes the words of the round before.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTED = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
# Fixed values of XXH32.
P1, P2, P3, P4, P5 = 2654435761, 2246822519, 3266489917, 668265263, 374761393
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def right(x: str, n: int) -> str:
    return f"(((({x}) * {TWICE}::UBIGINT) >> {n}) & {MASK})"


def left(x: str, n: int) -> str:
    return right(x, 32 - n)


def word(x: str) -> str:
    """A little-endian word of eight hexadecimal digits."""
    return "('0x' || " + " || ".join(f"substr({x}, {k}, 2)" for k in (7, 5, 3, 1)) + ")::UBIGINT"


def compressed(source: str, keep: str) -> str:
    """BLAKE3's compression: ``keep`` and g0..g7 for a source with h0..h7, m0..m15, block_size, flags, counter."""
    ms, vs = [f"m{k}" for k in range(16)], [f"v{k}" for k in range(16)]
    start = [f"h{k} AS v{k}" for k in range(8)] + [f"{IV[k]}::UBIGINT AS v{8 + k}" for k in range(4)]
    start += ["counter::UBIGINT AS v12", "0::UBIGINT AS v13", "block_size::UBIGINT AS v14", "flags::UBIGINT AS v15"]
    out = f"SELECT {keep}, {', '.join(ms)}, {', '.join(start)} FROM ({source})"
    order = list(range(16))
    for _ in range(7):
        for lanes, first in (((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15)), 0), (((0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)), 8):
            new = {}
            for k, (a, b, c, d) in enumerate(lanes):
                x, y = (f"m{order[first + 2 * k + j]}" for j in (0, 1))
                a1 = f"((v{a} + v{b} + {x}) & {MASK})"
                d1 = right(f"xor(v{d}, {a1})", 16)
                c1 = f"((v{c} + {d1}) & {MASK})"
                b1 = right(f"xor(v{b}, {c1})", 12)
                a2 = f"(({a1} + {b1} + {y}) & {MASK})"
                d2 = right(f"xor({d1}, {a2})", 8)
                c2 = f"(({c1} + {d2}) & {MASK})"
                new |= {a: a2, b: right(f"xor({b1}, {c2})", 7), c: c2, d: d2}
            out = f"SELECT {keep}, {', '.join(ms)}, {', '.join(f'{new[k]} AS v{k}' for k in range(16))} FROM ({out})"
        order = [order[k] for k in PERMUTED]
    return f"SELECT {keep}, {', '.join(f'xor(v{k}, v{k + 8}) AS g{k}' for k in range(8))} FROM ({out})"


def blake3(source: str, name: str) -> str:
    """CTEs for a recursive WITH; the last, ``name``, has id and digest (hexadecimal) for a source with id and x (hexadecimal)."""
    hs, gs = ", ".join(f"h{k}" for k in range(8)), ", ".join(f"g{k} AS h{k}" for k in range(8))
    start = ", ".join(f"{v}::UBIGINT AS h{k}" for k, v in enumerate(IV))
    words = ", ".join(f"{word(f'substr(p, {8 * k + 1}, 8)')} AS m{k}" for k in range(16))
    block = f"""SELECT v.id, v.chunk, v.block + 1 AS block, c.blocks, c.chunks, {', '.join(f'v.h{k}' for k in range(8))}, v.chunk AS counter, {words.replace('(p,', '(c.pieces[v.block + 1],')},
      c.last_size[v.block + 1] AS block_size,
      CASE WHEN v.block = 0 THEN 1 ELSE 0 END + CASE WHEN v.block + 1 = c.blocks THEN CASE WHEN c.chunks = 1 THEN 10 ELSE 2 END ELSE 0 END AS flags
    FROM {name}_v v JOIN {name}_c c ON v.id = c.id AND v.chunk = c.chunk WHERE v.block < c.blocks"""
    pairs = ", ".join([f"a.h{k} AS m{k}" for k in range(8)] + [f"b.h{k} AS m{k + 8}" for k in range(8)])
    parent = f"SELECT a.id, a.level + 1 AS level, a.pos // 2 AS pos, (a.n + 1) // 2 AS n, {start}, {pairs}, 0 AS counter, 64 AS block_size, CASE WHEN a.n = 2 THEN 12 ELSE 4 END AS flags FROM {name}_t a JOIN {name}_t b ON a.id = b.id AND b.pos = a.pos + 1 AND b.level = a.level WHERE a.pos % 2 = 0 AND a.n > 1"
    little = lambda h: " || ".join(f"substr(printf('%08x', {h}), {k}, 2)" for k in (7, 5, 3, 1))
    return f"""{name}_b AS (SELECT id, x, CASE WHEN x = '' THEN [''] ELSE list_transform(range(0, (length(x) + 2047) // 2048), lambda k: substr(x, CAST(k * 2048 + 1 AS BIGINT), 2048)) END AS parts FROM ({source})),
{name}_c AS (SELECT id, CAST(len(parts) AS BIGINT) AS chunks, CAST(i - 1 AS BIGINT) AS chunk, CASE WHEN part = '' THEN [repeat('0', 128)] ELSE list_transform(regexp_extract_all(part, '.{{1,128}}'), lambda s: rpad(s, 128, '0')) END AS pieces,
  CASE WHEN part = '' THEN [0] ELSE list_transform(regexp_extract_all(part, '.{{1,128}}'), lambda s: length(s) // 2) END AS last_size, CAST(greatest((length(part) + 127) // 128, 1) AS BIGINT) AS blocks
  FROM (SELECT id, parts, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM {name}_b)),
{name}_v AS (SELECT id, chunk, CAST(0 AS BIGINT) AS block, blocks, chunks, {start} FROM {name}_c UNION ALL
  SELECT id, chunk, block, blocks, chunks, {gs} FROM ({compressed(block, "id, chunk, block, blocks, chunks")})),
{name}_t AS (SELECT id, CAST(0 AS BIGINT) AS level, chunk AS pos, chunks AS n, {hs} FROM {name}_v WHERE block = blocks UNION ALL
  (SELECT id, level, pos, n, {gs} FROM ({compressed(parent, "id, level, pos, n")}) UNION ALL
   SELECT id, level + 1, pos // 2, (n + 1) // 2, {hs} FROM {name}_t WHERE n > 1 AND n % 2 = 1 AND pos = n - 1)),
{name} AS (SELECT id, {" || ".join(little(f"h{k}") for k in range(8))} AS digest FROM {name}_t WHERE n = 1)"""


def xxh32(source: str) -> str:
    """id, part, f: the hash of each hexadecimal string ``x`` of a source with id, part, x."""
    turn = f"lambda a, x: ({left(f'(a + x * {P2}) & {MASK}', 13)} * {P1}) & {MASK}"
    lane = lambda j, seed: f"list_reduce(list_prepend({seed}::UBIGINT, w[{j} : 4 * stripes : 4]), {turn})"
    seeds = ((P1 + P2) & MASK, P2, 0, (-P1) & MASK)
    lanes = ", ".join(f"{lane(j + 1, s)} AS a{j}" for j, s in enumerate(seeds))
    whole = f"CASE WHEN stripes > 0 THEN {' + '.join(left(f'a{j}', n) for j, n in enumerate((1, 7, 12, 18)))} ELSE {P5}::UBIGINT END"
    four = f"list_reduce(list_prepend(h, w[4 * stripes + 1 :]), lambda a, x: ({left(f'(a + x * {P3}) & {MASK}', 17)} * {P4}) & {MASK})"
    one = f"list_reduce(list_prepend(h, tail), lambda a, x: ({left(f'(a + x * {P5}) & {MASK}', 11)} * {P1}) & {MASK})"
    mixed = lambda x, n, p: f"(xor({x}, {x} >> {n}) * {p}) & {MASK}"
    return f"""SELECT id, part, xor(h, h >> 16) AS f FROM (SELECT id, part, {mixed('h', 13, P3)} AS h FROM (SELECT id, part, {mixed('h', 15, P2)} AS h FROM (
  SELECT id, part, {one} AS h FROM (SELECT id, part, tail, {four} AS h FROM (SELECT id, part, w, stripes, tail, ({whole} + size) & {MASK} AS h FROM (
  SELECT id, part, w, stripes, tail, size, {lanes} FROM (SELECT id, part, length(x) // 2 AS size, length(x) // 32 AS stripes,
    list_transform(regexp_extract_all(x, '.{{8}}'), lambda s: {word('s')}) AS w,
    list_transform(regexp_extract_all(substr(x, length(x) // 8 * 8 + 1), '..'), lambda s: ('0x' || s)::UBIGINT) AS tail FROM ({source}))))))))"""


def xxh32_thirteen(source: str) -> str:
    """id, f: the hash of strings ``s`` of thirteen ASCII characters, without lists: three words and a byte."""
    at = lambda n: " + ".join(f"ascii(substr(s, {4 * n + k + 1}, 1))::UBIGINT * {256**k}" for k in range(4))
    out = f"SELECT id, s, {P5 + 13}::UBIGINT AS h FROM ({source})"
    for n in range(3):
        out = f"SELECT id, s, ({left(f'(h + (({at(n)}) * {P3} & {MASK})) & {MASK}', 17)} * {P4}) & {MASK} AS h FROM ({out})"
    out = f"SELECT id, ({left(f'(h + ascii(substr(s, 13, 1))::UBIGINT * {P5}) & {MASK}', 11)} * {P1}) & {MASK} AS h FROM ({out})"
    for n, p in ((15, P2), (13, P3)):
        out = f"SELECT id, (xor(h, h >> {n}) * {p}) & {MASK} AS h FROM ({out})"
    return f"SELECT id, xor(h, h >> 16) AS f FROM ({out})"


def cuts(source: str, average: int = 1024) -> str:
    """id, bytes (two digits each), ends: where content-defined chunks end, for a source with id and x (hexadecimal)."""
    least, most, bits = average // 4, 8 * average, round(average.bit_length() - 1)
    centre = average - (least + -(-least // 2))
    strict, loose = (1 << bits + 1) - 1, (1 << bits - 1) - 1
    p, off = "(CASE WHEN x[1] - s[2] >= {0} THEN (s[1] >> 1) + x[2] ELSE 0 END)".format(least), "(x[1] - s[2])"
    passes = f"({off} >= {least} AND {p} & CASE WHEN {off} < {centre} THEN {strict} ELSE {loose} END = 0 OR {off} + 1 = {most})"
    step = f"lambda s, x: CASE WHEN {passes} THEN list_append(list_concat([0, x[1] + 1], s[3:]), x[1] + 1) ELSE list_concat([{p}, s[2]], s[3:]) END"
    table = "[" + ", ".join(map(str, gear().tolist())) + "]::BIGINT[]"
    return f"""SELECT id, bytes, CASE WHEN len(found) = 0 OR found[-1] < len(bytes) THEN list_append(found, len(bytes)) ELSE found END AS ends FROM (
  SELECT id, bytes, list_reduce(list_prepend([0, 0]::BIGINT[], list_transform(bytes, lambda b, i: [CAST(i - 1 AS BIGINT), g.t[('0x' || b)::BIGINT + 1]])), {step})[3:] AS found
  FROM (SELECT id, regexp_extract_all(x, '..') AS bytes FROM ({source})), (SELECT {table} AS t) g)"""


def chunks(source: str) -> str:
    """id, part (from 0), x: the chunks of each hexadecimal string."""
    return f"""SELECT id, CAST(i - 1 AS BIGINT) AS part, CASE WHEN ends[i] = 0 THEN '' ELSE array_to_string(bytes[CASE WHEN i = 1 THEN 1 ELSE ends[i - 1] + 1 END : ends[i]], '') END AS x
  FROM (SELECT id, bytes, ends, unnest(range(1, len(ends) + 1)) AS i FROM ({cuts(source)}))"""


def minima(source: str) -> str:
    """id, v: the 64 lowest bits of the minima, as a number, for a source with id and f."""

    def hashed(a: int, b: int) -> str:
        """a f + b modulo 2^64 in two halves, which spares numbers of 128 bits."""
        t = f"f * {a & MASK}"
        lo = f"(({t}) & {MASK}) + {b & MASK}"
        hi = f"((f * {a >> 32}) & {MASK}) + (({t}) >> 32) + {b >> 32} + (({lo}) >> 32)"
        return f"((((({hi}) & {MASK}) * {1 << 32}) + (({lo}) & {MASK})) % {MERSENNE}) & {MASK}"

    low = ", ".join(f"min({hashed(a, b)}) AS m{k}" for k, (a, b) in enumerate(zip(MINHASH_A, MINHASH_B, strict=True)))
    value = " + ".join(f"(m{k} % 2)::HUGEINT * {1 << (63 - k)}" for k in range(64))
    return f"SELECT id, printf('%016x', CAST({value} AS UBIGINT)) AS v FROM (SELECT id, {low} FROM (SELECT id, f::UBIGINT AS f FROM ({source})) GROUP BY id)"


def majority(source: str, digits: int = 16) -> str:
    """id, v: the SimHash of the first hexadecimal digits of ``digest``, for a source with id and digest."""
    bit = lambda k: f"CASE WHEN 2 * sum(n{k // 4} >> {3 - k % 4} & 1) >= count(*) THEN {8 >> k % 4} ELSE 0 END"
    text = " || ".join("printf('%x', CAST(" + " + ".join(bit(4 * d + j) for j in range(4)) + " AS BIGINT))" for d in range(digits))
    return f"SELECT id, {text} AS v FROM (SELECT id, {', '.join(f"('0x' || substr(digest, {d + 1}, 1))::BIGINT AS n{d}" for d in range(digits))} FROM ({source})) GROUP BY id"


def base32(x: str, digits: int) -> str:
    """Unpadded base32 of a hexadecimal string of so many digits; x is a column."""
    n = -(-digits * 4 // 5)
    padded = f"rpad({x}, {-(-digits // 10) * 10}, '0')"
    return " || ".join(f"substr('{ALPHABET}', CAST(('0x' || substr({padded}, {k // 8 * 10 + 1}, 10))::BIGINT >> {35 - 5 * (k % 8)} & 31 AS BIGINT) + 1, 1)" for k in range(n))


def unit(head: str, v: str) -> str:
    """A unit of 64 bits with its prefix; v is an expression of 16 digits."""
    return f"'ISCC:' || {base32(f"('{head}' || {v})", 20)}"


def hexed(table: str, key: str, text: str) -> str:
    return f"SELECT {key} AS id, lower(hex(encode({text}))) AS x FROM {table}"


def generators(source: str) -> str:
    """A recursive WITH whose last table, ``codes``, has id, size, data, instance (16 digits each) and digest."""
    return f"""WITH RECURSIVE raw AS ({source}), {blake3("SELECT id, x FROM raw", "whole")},
features AS ({xxh32(chunks("SELECT id, x FROM raw"))}), low AS ({minima("SELECT id, f FROM features")}),
codes AS (SELECT id, CAST(length(x) // 2 AS BIGINT) AS size, v AS data, substr(digest, 1, 16) AS instance, digest FROM raw JOIN low USING (id) JOIN whole USING (id))"""
