"""One query for each operator, and DuckDB SQL where SQL can express it.

The SQL is a second implementation: it shares no code with the functions, only the published constants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismark import functions as P
from prismark import operators as O
from prismark.plans import oracles as X
from prismark.selftest import KNOWN, answers
from prismark.sources import ChunkedFiles, file_codes, files, piece_codes, reached, spread
from prismark.tables import MERSENNE, MINHASH_A, MINHASH_B, frame_pairs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest64(seed: Column) -> Column:
    """Eight bytes of an id, as test digests: the id, spread by a factor, in big-endian order."""
    return F.unhex(F.lpad(F.hex(seed * 1_000_003 + 17), 16, "0"))


# Text

#: A collapsed text: lower case, without accents, white space, control characters, marks and punctuation.
COLLAPSED = r"regexp_replace(lower(strip_accents({x})), '[\s\x0B\pC\pM\pP\pZ]', '', 'g')"
BLANK = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


_TEXT_GRAMS = f"""
WITH t AS (SELECT doc_id, {COLLAPSED.format(x="text")} AS t FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN length(t) < 13 THEN t ELSE substr(t, CAST(i AS BIGINT), 13) END AS s FROM t, range(1, greatest(length(t) - 11, 2)) r(i)),
u AS (SELECT DISTINCT s, length(s) = 13 AND octet_length(encode(s)) = 13 AS plain FROM g),
h AS ({X.xxh32_thirteen("SELECT s AS id, s FROM u WHERE plain")} UNION ALL SELECT id, f FROM ({X.xxh32("SELECT s AS id, 0 AS part, lower(hex(encode(s))) AS x FROM u WHERE NOT plain")})),
m AS ({X.minima("SELECT g.doc_id AS id, h.f FROM g JOIN h ON g.s = h.id")})
"""


@query(_TEXT_GRAMS + f"SELECT doc_id, {X.unit('2001', 'v')} AS iscc, CAST(length(t) AS BIGINT) AS characters FROM t JOIN m ON t.doc_id = m.id")
def text_code_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", P.text_code("text").alias("c")).select("doc_id", "c.iscc", "c.characters")


@query(f"SELECT doc_id, trim(regexp_replace(text, '{BLANK}+', ' ', 'g')) AS line FROM documents")
def text_remove_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.text_remove_newlines("text").alias("line"))


@query("SELECT p_partkey, trim(substr(p_type || '  ' || p_name, 1, 17)) AS start FROM part")
def text_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", P.text_trim(F.concat("p_type", F.lit("  "), "p_name"), 17).alias("start"))


@query(r"SELECT p_partkey, lower(regexp_replace(p_name || ', ' || p_brand || ' ' || p_type, '[\s\pP]', '', 'g')) AS collapsed FROM part")
def text_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", P.text_collapse(F.concat_ws(" ", F.concat("p_name", F.lit(",")), "p_brand", "p_type")).alias("collapsed"))


@query(f"SELECT doc_id, {COLLAPSED.format(x='text')} AS collapsed FROM documents")
def text_collapse_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", P.text_collapse("text").alias("collapsed"))


@query(r"SELECT c_custkey, c_name || chr(10) || ' ' || chr(10) || c_mktsegment AS clean FROM customer")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the blank lines between, the first stays with its blank; the tab and the bell are control characters and go."""
    noisy = F.concat(F.lit(" "), "c_name", F.lit("\r\n \n\t\n\x07"), "c_mktsegment", F.lit("\n"))
    return table(spark, sf_dir, "customer").select("c_custkey", P.text_clean(noisy).alias("clean"))


#: Runs of blank lines as their first, which keeps its blanks, in texts without other white space than blanks and line feeds.
_CLEAN_SQL = r"trim(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '\n( *)\n( *\n)+', concat(chr(10), '\1', chr(10)), 'g'), ' ' || chr(10))"


@query(f"SELECT doc_id, {_CLEAN_SQL} AS clean FROM documents")
def text_clean_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", P.text_clean("text").alias("clean"))


# Windows


@query("SELECT c_custkey, CAST(i AS BIGINT) AS pos, substr(c_name, CAST(i AS BIGINT) + 1, 3) AS gram FROM customer, range(0, greatest(length(c_name) - 2, 1)) t(i)")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ngram_rows(table(spark, sf_dir, "customer"), "c_name", 3, "c_custkey").select("c_custkey", F.col("pos").cast("bigint").alias("pos"), "gram")


@query("SELECT doc_id, CAST(greatest(length(text) - 12, 1) AS BIGINT) AS n FROM documents")
def sliding_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.size(P.sliding_window("text", 13)).cast("bigint").alias("n"))


@query("SELECT s_suppkey, string_agg(hex(encode(substr(s_name, CAST(i AS BIGINT), 4))), ' ' ORDER BY i) AS grams FROM supplier, range(1, greatest(length(s_name) - 2, 2)) t(i) GROUP BY s_suppkey")
def sliding_window_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.transform(P.sliding_window_bytes("s_name", 4), F.hex), " ").alias("grams"))


@query("SELECT l_orderkey, part, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM (SELECT *, CAST(ntile(4) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS part FROM lineitem) GROUP BY ALL")
def array_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = O.split_parts(table(spark, sf_dir, "lineitem"), 4, ["l_linenumber", "l_partkey", "l_suppkey"], "l_orderkey")
    return parts.groupBy("l_orderkey", "part").agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("bigint").alias("lines"))


# Aggregates


def _minhash_sql(source: str, key: str, feature: str) -> str:
    """64 minima in 128-bit arithmetic, then four bits of each, hexadecimal."""
    low = ", ".join(f"min((({a}::HUGEINT * {feature} + {b}::HUGEINT) % 18446744073709551616 % {MERSENNE}) % 4294967296)::BIGINT AS m{k}" for k, (a, b) in enumerate(zip(MINHASH_A, MINHASH_B, strict=True)))
    nibble = lambda k, m: "hex(" + " + ".join(f"((m{m + j} >> {k}) & 1) * {8 >> j}" for j in range(4)) + ")"
    text = " || ".join(nibble(k, m) for k in range(4) for m in range(0, 64, 4))
    return f"SELECT {key}, {text} AS digest FROM (SELECT {key}, {low} FROM {source} GROUP BY {key})"


@query(_minhash_sql("lineitem", "l_orderkey", "l_partkey"))
def minhash_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.minhash_digests(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey").select("l_orderkey", F.hex("digest").alias("digest"))


def _word_sql(name: str, on: str = "true") -> str:
    """Eight hexadecimal digits of the majority of 32 bits of column v, over the rows where ``on`` holds."""
    bits = " + ".join(f"CASE WHEN count(*) FILTER (WHERE {on}) > 0 AND 2 * coalesce(sum(((v >> {31 - k}) & 1)) FILTER (WHERE {on}), 0) >= count(*) FILTER (WHERE {on}) THEN {1 << (31 - k)} ELSE 0 END" for k in range(32))
    return f"lpad(hex(CAST({bits} AS BIGINT)), 8, '0'){name}"


SIGNED = "(CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE -1 END * (CAST(l_partkey AS BIGINT) * 104729 + l_linenumber) % 2147483647)"


@query(f"SELECT l_orderkey, {_word_sql(' AS digest')} FROM (SELECT l_orderkey, CAST({SIGNED} AS BIGINT) AS v FROM lineitem) GROUP BY l_orderkey")
def simhash_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(SIGNED).alias("v"))
    return O.simhash_digests(rows, "v", "l_orderkey").select("l_orderkey", F.hex("digest").alias("digest"))


_AUDIO_SQL = f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST({SIGNED} AS BIGINT) AS v FROM lineitem),
y AS (SELECT l_orderkey, v, ntile(4) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS q,
             ntile(3) OVER (PARTITION BY l_orderkey ORDER BY v, l_linenumber, l_partkey, l_suppkey) AS t FROM x)
SELECT l_orderkey, {" || ".join(_word_sql("", on) for on in ("true", *(f"q = {k}" for k in range(1, 5)), *(f"t = {k}" for k in range(1, 4))))} AS digest FROM y GROUP BY l_orderkey
"""


@query(_AUDIO_SQL)
def audio_digests_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(SIGNED).alias("v"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"))
    return O.audio_digests(rows, "v", "pos", "l_orderkey").select("l_orderkey", F.hex("digest").alias("digest"))


@query(f"SELECT l_orderkey, {X.unit('2201', 'lower(substr(digest, 1, 16))')} AS iscc FROM ({_AUDIO_SQL})")
def audio_code_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.expr(SIGNED).cast("int").alias("v")).alias("x"))
    track = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x")).select("l_orderkey", F.col("x.v").alias("v"))
    return track.select("l_orderkey", P.audio_code("v").iscc.alias("iscc"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame signatures of nations: a frame of 380 numbers for each supplier, some of them equal."""
    frame = F.transform(F.sequence(F.lit(1), F.lit(380)), lambda i: ((F.col("s_suppkey") % 40 + 1) * i * 31 % 1009).cast("int"))
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(frame).alias("frames"))


_VIDEO_SQL = f"""
WITH f AS (SELECT DISTINCT s_nationkey, s_suppkey % 40 + 1 AS s FROM supplier),
g AS (SELECT s_nationkey, i, sum(s * i * 31 % 1009) AS v FROM f, range(1, 381) t(i) GROUP BY ALL),
h AS (SELECT s_nationkey, list(v ORDER BY i) AS v FROM g GROUP BY s_nationkey)
SELECT s_nationkey, {" || ".join("hex(" + " + ".join(f"CASE WHEN v[{i + 1}] < v[{j + 1}] THEN {8 >> n} ELSE 0 END" for n, (i, j) in enumerate(frame_pairs()[k : k + 4])) + ")" for k in range(0, 64, 4))} AS digest FROM h
"""


@query(_VIDEO_SQL)
def video_digests_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.video_digest_native(_frames(spark, sf_dir), "frames", "s_nationkey").select("s_nationkey", F.hex("digest").alias("digest"))


@query(_VIDEO_SQL)
def video_digests_by_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("s_nationkey", F.hex(P.video_digest("frames")).alias("digest"))


@query(f"SELECT s_nationkey, {X.unit('2301', 'lower(digest)')} AS iscc FROM ({_VIDEO_SQL})")
def video_code_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("s_nationkey", P.video_code("frames").iscc.alias("iscc"))


@query("SELECT l_orderkey, median(CAST(l_partkey AS DOUBLE)) AS middle FROM lineitem GROUP BY l_orderkey")
def median_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.median("l_partkey").alias("middle"))


# Hashes, chunks, transforms


def _xxh32_sql(source: str, key: str, text: str) -> str:
    """XXH32 of eight-byte ASCII strings: two words, then the final mixing, modulo 2^32 at every step."""
    p1, p2, p3, p4, p5 = 2654435761, 2246822519, 3266489917, 668265263, 374761393
    word = lambda n: " + ".join(f"ascii(substr({text}, {n + k + 1}, 1))::HUGEINT * {256**k}" for k in range(4))
    turn = lambda x, n: f"((({x} * {1 << n}) % 4294967296) + ({x} // {1 << (32 - n)}))"
    return f"""
WITH a AS (SELECT {key}, {word(0)} AS w0, {word(4)} AS w1 FROM {source}),
b AS (SELECT *, ({p5 + 8} + w0 * {p3}) % 4294967296 AS h FROM a), c AS (SELECT {key}, w1, {turn("h", 17)} * {p4} % 4294967296 AS h FROM b),
d AS (SELECT {key}, (h + w1 * {p3}) % 4294967296 AS h FROM c), e AS (SELECT {key}, {turn("h", 17)} * {p4} % 4294967296 AS h FROM d),
f AS (SELECT {key}, xor(h, h // 32768) * {p2} % 4294967296 AS h FROM e), g AS (SELECT {key}, xor(h, h // 8192) * {p3} % 4294967296 AS h FROM f)
SELECT {key}, CAST(xor(h, h // 65536) AS BIGINT) AS hash FROM g"""


@query(_xxh32_sql("part", "p_partkey", "lpad(p_brand, 8, '_')"))
def xxh32_of_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", P.xxh32(F.lpad("p_brand", 8, "_").cast("binary")).alias("hash"))


@query("SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, true AS whole FROM pages")
def cdc_chunks_join_to_the_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    chunks = F.transform(P.cdc_chunks(F.col("html").cast("binary")), F.hex)
    cut = pages.select("page_id", F.hex(F.col("html").cast("binary")).alias("raw"), F.array_join(chunks, "").alias("joined"))
    return cut.select("page_id", (F.length("joined") / 2).cast("bigint").alias("n_bytes"), (F.col("raw") == F.col("joined")).alias("whole"))


@query(f"SELECT id AS page_id, CAST(part AS INT) AS seq, CAST(length(x) // 2 AS INT) AS size FROM ({X.chunks(X.hexed('pages', 'page_id', 'html'))})")
def cdc_chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.col("html").cast("binary").alias("b"))
    return O.chunk_rows(rows, "b", "page_id").select("page_id", "seq", F.octet_length("chunk").alias("size"))


_DCT_SQL = f"""
WITH v AS (SELECT s_suppkey, n, CAST((s_suppkey * (n + 3) * 7) % 101 AS DOUBLE) AS x FROM supplier, range(0, 8) t(n))
SELECT s_suppkey, k, CAST(round(sum(x * cos(pi() * (n + 0.5) * k / 8)) * 1000) AS BIGINT) AS milli FROM v, range(0, 8) u(k) GROUP BY ALL
"""


@query(_DCT_SQL)
def dct_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda n: ((F.col("s_suppkey") * (n + 3) * 7) % 101).cast("double"))
    out = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(P.dct(x)).alias("k", "y"))
    return out.select("s_suppkey", F.col("k").cast("bigint").alias("k"), F.round(F.col("y") * 1000).cast("bigint").alias("milli"))


#: Coefficients of rows and columns 0 to 8, then four blocks of eight by eight from (0, 0), (1, 0), (0, 1) and (1, 1) on.
_COEFFICIENTS = """
WITH p AS (SELECT c_custkey, k, sha256(c_custkey || '-' || k) AS x FROM customer, range(0, 32) t(k)),
c AS (SELECT n, k, cos(pi() * (n + 0.5) * k / 32) AS c FROM range(0, 32) a(n), range(0, 9) b(k)),
r AS (SELECT c_custkey, p.k AS row, c.k AS col, sum(('0x' || substr(x, CAST(2 * n + 1 AS BIGINT), 2))::BIGINT * c) AS v FROM p, c GROUP BY ALL),
w AS (SELECT c_custkey, c.k AS row, col, sum(v * c) AS v FROM r JOIN c ON r.row = c.n GROUP BY ALL),
d AS (SELECT c_custkey, block, row - r AS row, col - c AS col, v FROM w, (VALUES (0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)) t(block, c, r) WHERE row BETWEEN r AND r + 7 AND col BETWEEN c AND c + 7),
b AS (SELECT c_custkey, block, row, sum(CASE WHEN v > m THEN 1 << CAST(7 - col AS INT) ELSE 0 END) AS b FROM d JOIN (SELECT c_custkey, block, median(v) AS m FROM d GROUP BY ALL) USING (c_custkey, block) GROUP BY ALL),
h AS (SELECT c_custkey, string_agg(printf('%02x', CAST(b AS BIGINT)), '' ORDER BY block, row) AS v FROM b GROUP BY ALL)
"""


@query(_COEFFICIENTS + f"SELECT c_custkey, 'ISCC:' || {X.base32("('2107' || v)", 68)} AS iscc FROM h")
def image_code_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pictures whose rows are digests: no coefficient is so near to the median that the order of a sum decides."""
    pixels = F.unhex(F.concat(*[F.sha2(F.concat(F.col("c_custkey").cast("string"), F.lit(f"-{k}")), 256) for k in range(32)]))
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", pixels.alias("pixels")).select("c_custkey", P.image_code("pixels", 256).iscc.alias("iscc"))


@query(_COEFFICIENTS + f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN {X.unit('2101', 'v')} END AS iscc FROM h")
def image_code_leniently(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other picture lacks a row, and so has no code."""
    rows = [F.sha2(F.concat(F.col("c_custkey").cast("string"), F.lit(f"-{k}")), 256) for k in range(31)]
    last = F.when(F.col("c_custkey") % 2 == 1, F.sha2(F.concat(F.col("c_custkey").cast("string"), F.lit("-31")), 256)).otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", F.unhex(F.concat(*rows, last)).alias("pixels")).select("c_custkey", P.try_image_code("pixels").iscc.alias("iscc"))


_INTERLEAVED = "upper(lpad(hex(CAST({x} AS BIGINT)), 32, '0'))"


@query(
    f"WITH d AS (SELECT n_nationkey, {_INTERLEAVED.format(x='n_nationkey * 1000003 + 17')} AS a, {_INTERLEAVED.format(x='n_nationkey * 7919 + 5')} AS b FROM nation) "
    "SELECT n_nationkey, substr(a,1,8)||substr(b,1,8)||substr(a,9,8)||substr(b,9,8)||substr(a,17,8)||substr(b,17,8)||substr(a,25,8)||substr(b,25,8) AS digest FROM d"
)
def interleave_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = lambda factor, plus: F.unhex(F.lpad(F.hex(F.col("n_nationkey").cast("bigint") * factor + plus), 32, "0"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.hex(O.interleaved(wide(1_000_003, 17), wide(7919, 5))).alias("digest"))


# Codec

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _unit_sql(head: str, value: str) -> str:
    """16 base32 characters of a two-byte header and eight bytes, by five bits."""
    return f"list_reduce(list_transform(range(0, 16), lambda i: substr('{_ALPHABET}', CAST((((({head})::HUGEINT * 18446744073709551616 + ({value})::HUGEINT) >> (75 - 5 * i)::INT) & 31) AS BIGINT) + 1, 1)), lambda x, y: x || y)"


def _units(df: DataFrame, seed: str) -> DataFrame:
    s = F.col(seed).cast("bigint")
    make = lambda m, t: P.encode_component(F.lit(m), F.lit(t), F.lit(0), F.lit(64), digest64(s + m))
    return df.select(seed, make(0, 0).alias("meta"), make(2, 0).alias("content"), make(3, 0).alias("data"), make(4, 0).alias("instance"))


@query(f"SELECT c_custkey, {_unit_sql('12289', '(c_custkey + 3) * 1000003 + 17')} AS code FROM customer")
def encode_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.col("data").alias("code"))


@query("SELECT c_custkey, CAST(3 AS INT) AS mtype, CAST(0 AS INT) AS stype, CAST(0 AS INT) AS version, CAST(1 AS INT) AS length, lpad(hex(CAST((c_custkey + 3) * 1000003 + 17 AS BIGINT)), 16, '0') AS digest FROM customer")
def iscc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _units(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", P.decode(F.concat(F.lit("ISCC:"), "data")).alias("x")).select("c_custkey", "x.*")
    return x.withColumn("digest", F.hex("digest"))


_COMPOSITE_SQL = "WITH u AS (SELECT c_custkey, " + ", ".join(f"{_unit_sql(str(h), f'(c_custkey + {m}) * 1000003 + 17')} AS u{m}" for m, h in ((0, 1), (2, 0x2001), (3, 0x3001), (4, 0x4001))) + " FROM customer)"


@query(_COMPOSITE_SQL + " SELECT c_custkey, CAST(t.p AS INT) AS pos, CASE t.p WHEN 0 THEN u0 WHEN 1 THEN u2 WHEN 2 THEN u3 ELSE u4 END AS unit FROM u, range(0, 4) t(p)")
def iscc_compose_and_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(table(spark, sf_dir, "customer"), "c_custkey")
    whole = units.select("c_custkey", P.compose(F.array("data", "meta", "instance", "content")).alias("code"))
    return O.decompose_rows(whole, "code", "c_custkey")


def _number(m: int | str) -> str:
    """The digest of a seed as 16 digits."""
    return f"printf('%016x', CAST((c_custkey + {m}) * 1000003 + 17 AS BIGINT))"


@query(f"SELECT c_custkey, 'ISCC:' || {X.base32('v', 68)} AS code FROM (SELECT c_custkey, '5005' || {' || '.join(map(_number, (0, 2, 3, 4)))} AS v FROM customer)")
def iscc_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spread(table(spark, sf_dir, "customer").select("c_custkey")), "c_custkey").select("c_custkey", P.compose(F.array("meta", "content", "data", "instance")).alias("code"))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'ISCC:' || {X.base32('v', 36)} END AS code FROM (SELECT c_custkey, '5500' || {_number(3)} || {_number(4)} AS v FROM customer)")
def iscc_compose_leniently(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data and instance units make a sum code; without the instance there is none."""
    units = _units(table(spark, sf_dir, "customer"), "c_custkey")
    listed = F.when(F.col("c_custkey") % 3 == 0, F.array("data", "meta")).otherwise(F.array("data", "instance"))
    return units.select("c_custkey", P.try_compose(listed).alias("code"))


_MIXED_SQL = f"""
WITH d AS (SELECT c_custkey, {", ".join(f"((c_custkey * {t + 2} * 1000003 + 17)::UBIGINT >> 8) + {(0x20 + t) << 56}::UBIGINT AS d{t}" for t in range(3))} FROM customer)
SELECT c_custkey, {X.unit("2401", "printf('%016x', (d0 & d1) | (d0 & d2) | (d1 & d2))")} AS iscc, CAST(3 AS INT) AS n_parts FROM d"""


@query(_MIXED_SQL)
def mixed_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("c_custkey").cast("bigint")
    make = lambda t: P.encode_component(F.lit(2), F.lit(t), F.lit(0), F.lit(64), digest64(s * (t + 2)))
    c = spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", P.mixed_code(F.array(make(0), make(1), make(2))).alias("c"))
    return c.select("c_custkey", "c.iscc", F.size("c.parts").alias("n_parts"))


def _nibbles(x: str) -> str:
    """A number from 0 to 4679 as bits in groups of four whose first bits tell how many there are."""
    bits = lambda x, n: f"right(bin(CAST({x} AS BIGINT) + {1 << n}), {n})"
    return f"CASE WHEN {x} < 8 THEN '0' || {bits(x, 3)} WHEN {x} < 72 THEN '10' || {bits(f'{x} - 8', 6)} WHEN {x} < 584 THEN '110' || {bits(f'{x} - 72', 9)} ELSE '1110' || {bits(f'{x} - 584', 12)} END"


_HEADER_SQL = f"""
WITH n AS (SELECT p_partkey, p_partkey % 8 AS m, p_size % 8 AS s, p_partkey * 7 % 4680 AS l FROM part),
b AS (SELECT *, {_nibbles('m')} || {_nibbles('s')} || '0000' || {_nibbles('l')} AS b FROM n)"""


@query(_HEADER_SQL + " SELECT p_partkey, (SELECT string_agg(printf('%x', CAST(('0b' || substr(b || '0000', 4 * CAST(k AS BIGINT) + 1, 4))::BIGINT AS BIGINT)), '' ORDER BY k) FROM range(0, length(b) // 8 * 2 + CASE WHEN length(b) % 8 > 0 THEN 2 ELSE 0 END) t(k)) AS header FROM b")
def encode_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of all sizes: a length up to 4,679."""
    fields = F.col("p_partkey") % 8, F.col("p_size") % 8, F.lit(0), F.col("p_partkey") * 7 % 4680
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(F.hex(P.encode_header(*fields))).alias("header"))


@query(_HEADER_SQL + " SELECT p_partkey, CAST(m AS INT) AS mtype, CAST(s AS INT) AS stype, CAST(0 AS INT) AS version, CAST(l AS INT) AS length, 'BEEF' AS tail FROM b")
def decode_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was encoded, and the bytes after it."""
    fields = F.col("p_partkey") % 8, F.col("p_size") % 8, F.lit(0), F.col("p_partkey") * 7 % 4680
    raw = F.concat(P.encode_header(*fields), F.unhex(F.lit("beef")))
    x = table(spark, sf_dir, "part").select("p_partkey", P.decode_header(raw).alias("x")).select("p_partkey", "x.*")
    return x.withColumn("tail", F.hex("tail"))


@query(f"SELECT p_partkey, {_nibbles('(p_partkey * 7 % 4680)')} AS bits, CAST(p_partkey * 7 % 4680 AS INT) AS back FROM part")
def varnibble(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = P.varnibble(F.col("p_partkey") * 7 % 4680)
    return table(spark, sf_dir, "part").select("p_partkey", bits.alias("bits"), P.read_varnibble(bits).value.alias("back"))


@query("SELECT p_partkey, CASE m WHEN 5 THEN CASE WHEN v BETWEEN 0 AND 7 THEN v END WHEN 6 THEN CASE WHEN v BETWEEN 64 AND 96 AND (v - 64) % 8 = 0 THEN (v - 64) // 8 END ELSE CASE WHEN v >= 32 AND v % 32 = 0 THEN v // 32 - 1 END END AS field FROM (SELECT p_partkey, CAST(p_partkey % 7 AS INT) AS m, CAST(p_size * 8 % 264 AS INT) AS v FROM part)")
def length_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of units, composites and ids alike; null where there is no such length."""
    return table(spark, sf_dir, "part").select("p_partkey", P.length_field((F.col("p_partkey") % 7).cast("int"), F.col("p_size") * 8 % 264).alias("field"))


@query("SELECT p_partkey, CAST(CAST(bit_count(p_size % 8) AS INT) * 64 + 128 AS INT) AS bits FROM part")
def length_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", P.length_bits(F.lit(5), F.col("p_size") % 8, F.lit(0)).alias("bits"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 > 2 THEN NULL ELSE CAST([4, 2, 1][p_size % 4 + 1] | 4 AS INT) END AS field FROM part")
def encode_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", P.units_field(F.array(F.lit(0), F.col("p_size") % 4)).alias("field"))


@query("SELECT p_partkey, p_size % 8 AS n, list_filter([CASE WHEN p_size % 8 & 1 = 1 THEN 2 END, CASE WHEN p_size % 8 & 2 = 2 THEN 1 END, CASE WHEN p_size % 8 & 4 = 4 THEN 0 END], lambda x: x IS NOT NULL).list_sort().list_transform(lambda x: CAST(x AS VARCHAR)).array_to_string(' ') AS units FROM part")
def decode_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 8).alias("n"), F.array_join(P.read_units_field(F.col("p_size") % 8).cast("array<string>"), " ").alias("units"))


@query("SELECT c_custkey, translate(rtrim(to_base64(encode(c_name || '~~?>' || c_mktsegment)), '='), '+/', '-_') AS b FROM customer")
def base64_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", P.base64_url(F.concat("c_name", F.lit("~~?>"), "c_mktsegment")).alias("b"))


@query("SELECT c_custkey, hex(encode(c_name)) AS raw FROM customer")
def base32_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.hex(P.read_base32(F.lower(P.to_base32(F.col("c_name").cast("binary"))))).alias("raw"))


def _text_code_sql(source: str, key: str, text: str) -> str:
    """The whole text code of ASCII texts of 13 letters or more: collapse, n-grams, XXH32, minima, base32."""
    p1, p2, p3, p4, p5 = 2654435761, 2246822519, 3266489917, 668265263, 374761393
    word = lambda n: " + ".join(f"ascii(substr(s, {4 * n + k + 1}, 1))::HUGEINT * {256**k}" for k in range(4))
    turn = lambda x, n: f"((({x} * {1 << n}) % 4294967296) + ({x} // {1 << (32 - n)}))"
    steps, last = [], "g"
    for n in range(3):
        steps += [f"a{n} AS (SELECT {key}, s, (h + ({word(n)}) * {p3}) % 4294967296 AS h FROM {last})", f"b{n} AS (SELECT {key}, s, {turn('h', 17)} * {p4} % 4294967296 AS h FROM a{n})"]
        last = f"b{n}"
    low = ", ".join(f"min((({a}::HUGEINT * f + {b}::HUGEINT) % 18446744073709551616 % {MERSENNE}) % 4294967296)::BIGINT AS m{k}" for k, (a, b) in enumerate(zip(MINHASH_A, MINHASH_B, strict=True)))
    value = " + ".join(f"(m{k} % 2)::HUGEINT * {1 << (63 - k)}" for k in range(64))
    return f"""
WITH t AS (SELECT {key}, lower(regexp_replace({text}, '[\\s\\pP]', '', 'g')) AS t FROM {source}),
g AS (SELECT DISTINCT {key}, substr(t, CAST(i AS BIGINT), 13) AS s, {p5 + 13}::HUGEINT AS h FROM t, range(1, length(t) - 11) r(i)),
{", ".join(steps)},
c AS (SELECT {key}, (h + ascii(substr(s, 13, 1))::HUGEINT * {p5}) % 4294967296 AS h FROM {last}),
d AS (SELECT {key}, {turn("h", 11)} * {p1} % 4294967296 AS h FROM c),
e AS (SELECT {key}, xor(h, h // 32768) * {p2} % 4294967296 AS h FROM d), f AS (SELECT {key}, xor(h, h // 8192) * {p3} % 4294967296 AS h FROM e),
u AS (SELECT {key}, xor(h, h // 65536) AS f FROM f), m AS (SELECT {key}, {low} FROM u GROUP BY {key}), v AS (SELECT {key}, {value} AS v FROM m)
SELECT {key}, 'ISCC:' || {_unit_sql("8193", "v")} AS iscc, CAST(length(t) AS BIGINT) AS characters FROM v JOIN t USING ({key})"""


LONG_NAME = "p_name || ' ' || p_type || ', made by ' || p_brand"


@query(_text_code_sql("part", "p_partkey", LONG_NAME))
def text_code_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", P.text_code(F.expr(LONG_NAME)).alias("c")).select("p_partkey", "c.iscc", "c.characters")


@query(_text_code_sql("part", "p_partkey", LONG_NAME))
def text_code_by_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relational form: a row for each n-gram, 64 minima, and the code from the digest."""
    rows = table(spark, sf_dir, "part").select("p_partkey", P.text_collapse(F.expr(LONG_NAME)).alias("t"))
    grams = O.ngram_rows(rows, "t", 13, "p_partkey", "t").select("p_partkey", F.length("t").cast("bigint").alias("characters"), P.xxh32(F.col("gram").cast("binary")).alias("f"))
    digests = O.minhash_digests(grams, "f", "p_partkey", "characters")
    code = P.encode_component(F.lit(2), F.lit(0), F.lit(0), F.lit(64), "digest")
    return digests.select("p_partkey", F.concat(F.lit("ISCC:"), code).alias("iscc"), "characters")


_FRAMES_SQL = f"""
WITH f AS (SELECT n_nationkey, i, sum((n_nationkey * 17 + (k * 380 + i) * 7) % 256) AS v FROM nation, range(0, 3) a(k), range(0, 380) b(i) GROUP BY ALL),
h AS (SELECT n_nationkey, list(v ORDER BY i) AS v FROM f GROUP BY n_nationkey),
d AS (SELECT n_nationkey, {" || ".join("printf('%x', " + " + ".join(f"CASE WHEN v[{i + 1}] < v[{j + 1}] THEN {8 >> n} ELSE 0 END" for n, (i, j) in enumerate(frame_pairs()[k : k + 4])) + ")" for k in range(0, 64, 4))} AS v FROM h)
SELECT n_nationkey, {X.unit('2301', 'v')} AS iscc FROM d"""


@query(_FRAMES_SQL)
def frame_buffers_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video codes of flat buffers of three frames."""
    number = F.transform(F.sequence(F.lit(0), F.lit(3 * 380 - 1)), lambda i: F.rpad(F.lpad(F.hex((F.col("n_nationkey") * 17 + i * 7) % 256), 2, "0"), 8, "0"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.unhex(F.array_join(number, "")).alias("b")).select("n_nationkey", P.frame_buffer_code("b", 3, 380).iscc.alias("iscc"))


# Generators over bytes and metadata


@query("SELECT event_id, 'data:application/json;base64,' || to_base64(encode('{\"n\":' || event_id || ',\"user\":\"' || event_type || '\"}')) AS url FROM events")
def json_data_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{ "user" : "'), "event_type", F.lit('", "n": '), F.col("event_id").cast("string"), F.lit(".0}"))
    return table(spark, sf_dir, "events").select("event_id", P.json_data_url(text).alias("url"))


@query("SELECT event_id, 'data:application/json;base64,' || to_base64(encode(regexp_replace(props, '[[:space:]]', '', 'g'))) AS url FROM events")
def json_data_url_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events").select("event_id", "props")).select("event_id", P.try_json_data_url("props").alias("url"))


@query("SELECT event_id, hex(encode(event_type)) AS raw FROM events")
def data_url_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("data:text/plain;charset=utf-8;base64,"), F.base64(F.col("event_type").cast("binary")))
    return table(spark, sf_dir, "events").select("event_id", F.hex(P.try_data_url_bytes(url)).alias("raw"))


def _grams(source: str, key: str, text: str, name: str) -> str:
    """``name``: id and x (hexadecimal) of each n-gram of three characters, as often as it occurs."""
    return f"{name} AS (SELECT {key} AS id, lower(hex(encode(substr(t, CAST(i AS BIGINT), 3)))) AS x FROM (SELECT {key}, {COLLAPSED.format(x=text)} AS t FROM {source}), range(1, greatest(length(t) - 1, 2)) r(i))"


_META_SQL = f"""
WITH RECURSIVE {_grams("part", "p_partkey", "p_name", "a")}, {_grams("part", "p_partkey", "p_type", "b")},
u AS (SELECT DISTINCT x FROM (SELECT x FROM a UNION ALL SELECT x FROM b)), {X.blake3("SELECT x AS id, x FROM u", "gram")},
n AS ({X.majority("SELECT a.id, digest FROM a JOIN gram ON a.x = gram.id", 8)}), d AS ({X.majority("SELECT b.id, digest FROM b JOIN gram ON b.x = gram.id", 8)}),
{X.blake3("SELECT p_partkey AS id, lower(hex(encode(p_name || ' ' || p_type))) AS x FROM part", "whole")}
SELECT p_partkey, {X.unit("0001", "n.v || d.v")} AS iscc, p_name AS name, p_type AS description, NULL::VARCHAR AS meta, '1e20' || digest AS metahash
FROM part JOIN n ON p_partkey = n.id JOIN d ON p_partkey = d.id JOIN whole ON p_partkey = whole.id"""


@query(_META_SQL)
def meta_code_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")).select("p_partkey", P.meta_code("p_name", "p_type").alias("c")).select("p_partkey", "c.*")


_EVENTS_SQL = f"""
WITH RECURSIVE e AS (SELECT event_id, event_type, regexp_replace(props, '[[:space:]]', '', 'g') AS p FROM events),
k AS (SELECT DISTINCT event_type FROM e), j AS (SELECT DISTINCT p FROM e), {_grams("k", "event_type", "event_type", "a")},
b AS (SELECT p AS id, substr(h, 2 * CAST(i AS BIGINT) - 1, 8) AS x FROM (SELECT p, lower(hex(encode(p))) AS h FROM j), range(1, greatest(length(h) // 2 - 2, 2)) r(i)),
u AS (SELECT DISTINCT x FROM (SELECT x FROM a UNION ALL SELECT x FROM b)), {X.blake3("SELECT x AS id, x FROM u", "gram")},
n AS ({X.majority("SELECT a.id, digest FROM a JOIN gram ON a.x = gram.id", 8)}), d AS ({X.majority("SELECT b.id, digest FROM b JOIN gram ON b.x = gram.id", 8)}),
{X.blake3("SELECT p AS id, lower(hex(encode(p))) AS x FROM j", "whole")}
SELECT event_id, {X.unit("0001", "n.v || d.v")} AS iscc, '1e20' || digest AS metahash FROM e JOIN n ON event_type = n.id JOIN d ON p = d.id JOIN whole ON p = whole.id"""


@query(_EVENTS_SQL)
def meta_code_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events").select("event_id", "event_type", "props")).select("event_id", P.try_meta_code("event_type", None, "props").alias("c")).select("event_id", "c.iscc", "c.metahash")


@query("SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS filesize FROM pages")
def instance_code_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.instance_code(F.col("html").cast("binary")).filesize.alias("filesize"))


_PAGES_SQL = X.generators(X.hexed("pages", "page_id", "html"))
#: A data and an instance unit as a composite, which has 18 bytes.
_SUM_SQL = f"'ISCC:' || {X.base32("('5500' || data || instance)", 36)}"


@query(_PAGES_SQL + f"SELECT id AS page_id, {X.unit('4001', 'instance')} AS iscc, '1e20' || digest AS datahash, size AS filesize FROM codes")
def instance_code_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", P.instance_code(F.col("html").cast("binary")).alias("c")).select("page_id", "c.*")


@query(_PAGES_SQL + f"SELECT id AS page_id, {X.unit('3001', 'data')} AS iscc FROM codes")
def data_code_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", P.data_code(F.col("html").cast("binary")).iscc.alias("iscc"))


@query(_PAGES_SQL + f"SELECT id AS page_id, {_SUM_SQL} AS iscc, '1e20' || digest AS datahash, size AS filesize, {X.unit('3001', 'data')} || ' ' || {X.unit('4001', 'instance')} AS units FROM codes")
def sum_code_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", P.sum_code(F.col("html").cast("binary"), units=True).alias("c")).select("page_id", "c.iscc", "c.datahash", "c.filesize", F.array_join("c.units", " ").alias("units"))


@query()
def sum_code_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of the folder; what their bytes are is beyond SQL, so the next query holds the codes against another way."""
    return _named(file_codes(spark, f"{sf_dir}/*.parquet")).select("name", "iscc", "datahash", "filesize")


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("SELECT name || '.parquet' AS name, true AS same FROM (VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") t(name)")
def chunked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read as rows of 64 KiB chunks and hashed piece by piece have the codes that the file scan gives.

    A table is a file or a folder of files, all of which must agree.
    """
    spark.dataSource.register(ChunkedFiles)
    shown, uri = reached(spark, sf_dir) or (sf_dir, sf_dir)

    def within(rows: DataFrame, root: str) -> DataFrame:
        """``file``: the path below the root, and ``name``: its first part, if that is a table."""
        file = F.substring("path", F.lit(len(root.rstrip("/")) + 2), F.length("path"))
        return rows.withColumn("file", file).withColumn("name", F.substring_index("file", "/", 1)).where(F.col("name").isin([f"{t}.parquet" for t in TABLES]))

    pieces = within(spark.read.format("chunked_files").option("size", 1 << 16).load(uri), FileSystem.from_uri(uri)[1])
    told = piece_codes(pieces, "file", "seq", "data").select("file", "sum_code", "datahash", "filesize")
    whole = within(file_codes(spark, f"{sf_dir}/*.parquet"), shown).select("name", "file", F.col("iscc").alias("code"), F.col("datahash").alias("hash"), F.col("filesize").alias("size"))
    same = (F.col("sum_code") == F.col("code")) & (F.col("datahash") == F.col("hash")) & (F.col("filesize") == F.col("size"))
    return whole.join(told, "file", "left").groupBy("name").agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("same"))


@query("SELECT conv_id, CAST(sum(octet_length(encode(text))) AS BIGINT) AS filesize FROM conversations GROUP BY conv_id")
def hashers_over_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codes(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "filesize")


@query(
    X.generators("SELECT conv_id AS id, string_agg(lower(hex(encode(text))), '' ORDER BY turn) AS x FROM conversations GROUP BY conv_id")
    + f"SELECT id AS conv_id, {_SUM_SQL} AS sum_code, {X.unit('3001', 'data')} AS data_code, {X.unit('4001', 'instance')} AS instance_code, '1e20' || digest AS datahash, size AS filesize FROM codes"
)
def hashers_over_turns_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codes(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(
    X.generators(X.hexed("documents", "doc_id", "text")) + f", w AS ({_TEXT_GRAMS} SELECT id, v AS content FROM m) "
    f"SELECT doc_id, 'ISCC:' || {X.base32('v', 52)} AS iscc FROM (SELECT codes.id AS doc_id, '5001' || content || data || instance AS v FROM codes JOIN w ON codes.id = w.id)"
)
def composite_code_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units of a document, and its composite code."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", P.text_code("text").iscc.alias("content"), P.sum_code(F.col("text").cast("binary"), units=True).units.alias("u"))
    return docs.select("doc_id", P.compose(F.concat(F.array("content"), "u")).alias("iscc"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{code}')" for name, (_, code) in KNOWN.items()) + ") t(name, code)")
def conformance_selftest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes out for the published inputs, beside the published outputs."""
    return answers(spark)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
