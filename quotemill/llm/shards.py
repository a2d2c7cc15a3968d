"""Extendible hashing of rows into byte-bounded shards, by DataFrame operations alone.

A shard is a prefix of the 60 hash bits of a row's key.  The directory starts with one bucket and only buckets over the
limit are split on another bit.  It is found from a histogram of bytes by hash prefix: bytes of all shorter prefixes are
sums over that table, and a cell's shard is the shortest prefix within the limit.  Cells that are still too large are
refined by further bits; rows whose key bits are all alike (copies of one key) go on to bits salted by the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_tasks, materialise

KEY_BITS = 60
#: Directories up to this many cells are broadcast: 1 Mi rows of 24 bytes.
BROADCAST_CELLS = 1 << 20


def key_hash(col: Column) -> Column:
    """60 bits of md5 of a key written as text; a null key counts as empty text."""
    digest = F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _directory(rows: DataFrame, bits: int, limit: int, tasks: int) -> DataFrame:
    """(cell, depth, prefix, shard_bytes) of the cells of (cell, bytes) at ``bits`` deep that fit the limit.

    A shard is a prefix that fits while its parent does not, so no shard is a prefix of another, and a cell is looked up at the depths
    that shards have.
    """
    tree = rows.select("bytes", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"), "cell")
    sums = tree.groupBy("depth", F.expr(f"shiftright(cell, {bits} - depth)").alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"))
    fits = materialise(sums.where(F.col("shard_bytes") <= limit), "fits", tasks)
    parents = fits.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    shards = materialise(fits.join(parents, ["depth", "prefix"], "left_anti"), "shards", tasks)
    n, least, most = shards.agg(F.count("*"), F.min("depth"), F.max("depth")).first()
    if not n:
        return rows.select("cell", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), F.col("bytes").alias("shard_bytes")).limit(0)
    cells = rows.select("cell", F.explode(F.sequence(F.lit(least), F.lit(most))).alias("depth"))
    cells = cells.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    return cells.join(_sized(shards, n), ["depth", "prefix"]).select("cell", "depth", "prefix", "shard_bytes")


def extendible_shards(
    docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", limit_bytes: int = 32 << 20, row_bytes: int = 32, cell_step: int = 12, max_bits: int = KEY_BITS + 36
) -> DataFrame:
    """``docs`` with shard (its hash-prefix bits as text, "" for the only shard), shard_depth and shard_bytes.

    A row counts ``row_bytes`` plus its text's UTF-8 bytes (a null text: none).  Shards hold at most ``limit_bytes``; a
    row that alone exceeds the limit gets a shard of its own, at the depth where it parts from all others or at
    ``max_bits``.  Rows of one key go together unless they exceed the limit, then they are told apart by text and by
    row.  Null ids are one key.  Texts are hashed and measured, never split, so their length costs nothing else.  An empty table gives no
    rows.  Columns called like the new ones are replaced.
    """
    names = [c for c in docs.columns if c not in ("shard", "shard_depth", "shard_bytes")]
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + row_bytes
    h = key_hash(F.col(key_col))
    total = docs.select(F.sum(size)).first()[0] or 0
    bits = min(KEY_BITS, max(0, (max(1, -(-total // limit_bytes)) - 1).bit_length()) + 4)
    cell = F.shiftrightunsigned(h, KEY_BITS - bits) if bits else F.lit(0).cast("long")
    tasks = few_tasks(docs)
    rows = materialise(docs.select(cell.alias("cell"), size.alias("bytes")).groupBy("cell").agg(F.sum("bytes").alias("bytes")), "cells", tasks)
    placed = _directory(rows, bits, limit_bytes, tasks)
    rest = rows.where(F.col("bytes") > limit_bytes)
    directory = placed.select("cell", F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), 64, "0").alias("code"), "depth", "shard_bytes")
    directory = directory.select("cell", F.expr("right(code, depth)").alias("shard"), F.col("depth").alias("shard_depth"), "shard_bytes")
    over = rest.count()
    tagged = docs.select(*[F.col(c) for c in names], cell.alias("_cell"))
    cells = 1 << bits
    if not over:
        return _attach(tagged, directory, names, cells)
    # Refine the cells that are still too large by longer codes: key bits, then text bits, then bits of the row itself.
    code = F.concat(
        F.lpad(F.conv(h.cast("string"), 10, 2), KEY_BITS, "0"),
        F.lpad(F.conv(F.substring(F.md5(F.concat(F.lit("t"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary")), 1, 3), 16, 2), 12, "0"),
        F.lpad(F.conv(F.substring(F.md5(F.monotonically_increasing_id().cast("string").cast("binary")), 1, 6), 16, 2), 24, "0"),
    )
    big = rest.select("cell")
    deep = docs.select(*[F.col(c) for c in names], cell.alias("_cell"), code.alias("_code"), size.alias("_size"))
    far = deep.join(_sized(big, over), F.col("_cell") == F.col("cell"), "left_semi")
    shallow = tagged.join(_sized(big, over), F.col("_cell") == F.col("cell"), "left_anti")
    parts = [_attach(shallow, directory, names, cells)]
    depth = bits
    far = materialise(far, "deep")
    while True:
        depth = min(max_bits, depth + cell_step)
        at = F.substring(F.col("_code"), 1, depth)
        cells = far.groupBy(at.alias("full")).agg(F.sum("_size").alias("bytes"))
        low = depth - cell_step
        tree = cells.select("full", "bytes", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("d")).withColumn("prefix", F.expr("left(full, d)"))
        sums = tree.groupBy("prefix", "d").agg(F.sum("bytes").alias("shard_bytes"))
        if depth < max_bits:
            sums = sums.where(F.col("shard_bytes") <= limit_bytes)
        else:
            sums = sums.where((F.col("shard_bytes") <= limit_bytes) | (F.col("d") == depth))
        own = tree.join(sums, ["prefix", "d"]).groupBy("full").agg(F.min(F.struct("d", "prefix", "shard_bytes")).alias("own"))
        own = materialise(own.select("full", F.col("own.prefix").alias("shard"), F.col("own.d").cast("int").alias("shard_depth"), F.col("own.shard_bytes").alias("shard_bytes")), "cells")
        keyed = far.withColumn("_full", at)
        parts.append(keyed.join(own, F.col("_full") == F.col("full")).select(*names, "shard", "shard_depth", "shard_bytes"))
        if depth >= max_bits:
            break
        far = materialise(keyed.join(own, F.col("_full") == F.col("full"), "left_anti").select(*names, "_cell", "_code", "_size"), "deep")
        if far.isEmpty():
            break
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _sized(cells: DataFrame, n: int) -> DataFrame:
    return F.broadcast(cells) if n <= BROADCAST_CELLS else cells


def _attach(tagged: DataFrame, directory: DataFrame, names: list[str], cells: int) -> DataFrame:
    """``directory`` has at most ``cells`` rows."""
    side = _sized(directory, cells)
    out = tagged.join(side, F.col("_cell") == F.col("cell"))
    return out.select(*names, "shard", F.col("shard_depth").cast("int").alias("shard_depth"), "shard_bytes")
