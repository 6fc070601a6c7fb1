"""One document from parallel parts: tasks write what lies between head and tail, and the parts become one file in order."""

from __future__ import annotations

import uuid

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write(rows: DataFrame, path: str, line: str, order: list[str], head: str, tail: str, separator: str = "") -> None:
    """Write the ``line`` column of ``rows`` as the file ``path``: ``head``, the lines in ``order``, ``tail``.

    Rows are dealt to tasks by ranges of the order, and each task writes its part sorted; ``separator`` stands before each
    line but the first of all. The parts are joined where they lie if the file system can (HDFS), and else copied one
    after another, a buffer at a time. The document gets its name last, so it is there whole or not at all; a file that
    is there already is an error. Rows that are null in ``line`` are left out.
    """
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(conf)
    if fs.exists(final):
        raise FileExistsError(path)
    aside = f"{final.getParent().toString()}-{uuid.uuid4().hex}"
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{aside}/{name}")
    rows = rows.where(F.col(line).isNotNull()).select(*order, line)
    try:
        if separator:
            text = F.concat(F.lit(separator), F.col(line))
        else:
            text = F.col(line)
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select(text.alias("value")).write.text(f"{aside}/parts")
        parts = sorted((f.getPath() for f in fs.listStatus(at("parts")) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda p: int(p.getName().split("-")[1]))
        _put(fs, at("document"), head.encode())
        if separator and parts:  # the first line of all stands behind the head
            _drop_first(jvm, fs, conf, parts[0], at("first"), len(separator.encode()))
            parts[0] = at("first")
        _put(fs, at("tail"), tail.encode())
        _join(spark, fs, conf, at("document"), [*parts, at("tail")] if tail else parts)
        fs.mkdirs(final.getParent())
        if not fs.rename(at("document"), final):
            raise FileExistsError(path)
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(aside), True)


def _put(fs, path, data: bytes) -> None:
    out = fs.create(path, False)
    try:
        out.write(data)
    finally:
        out.close()


def _drop_first(jvm, fs, conf, source, target, n: int) -> None:
    """A copy of a part without its first ``n`` bytes."""
    data, out = fs.open(source), fs.create(target, False)
    data.seek(n)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, conf, True)


def _join(spark, fs, conf, document, parts: list) -> None:
    """Append the parts to the document."""
    jvm = spark.sparkContext._jvm
    if not parts:
        return
    sources = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
    for i, part in enumerate(parts):
        sources[i] = part
    try:
        return fs.concat(document, sources)
    except UnsupportedOperationException:
        pass
    whole = jvm.org.apache.hadoop.fs.Path(f"{document.toString()}-joined")
    out = fs.create(whole, False)
    try:
        for part in [document, *parts]:
            data = fs.open(part)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, conf, False)
            data.close()
    finally:
        out.close()
    fs.delete(document, False)
    fs.rename(whole, document)
