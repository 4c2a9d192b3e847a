"""Numbered commits in a shared folder: each number is taken once, whoever asks first.

A number is a small file that is created only if it is absent, with its content, in one step: a
hard link on a local disk, a rename that does not overwrite elsewhere. So the order of
commits does not depend on anybody's clock.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

DIGITS = 20


class CommitConflict(RuntimeError):
    """Somebody else has committed to the same thing since its state was read."""


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _write_once(spark: SparkSession, folder: str, name: str, content: str) -> bool:
    """Create ``folder/name`` with its content unless it is there; did this call create it?"""
    jvm = spark._jvm
    where, fs = _fs(spark, folder)
    fs.mkdirs(where)
    draft = jvm.org.apache.hadoop.fs.Path(where, f".{name}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    target = jvm.org.apache.hadoop.fs.Path(where, name)
    try:
        if fs.getScheme() == "file":
            files = jvm.java.nio.file.Files
            place = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            files.createLink(place(target), place(draft))
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                fs.getUri(), spark._jsc.hadoopConfiguration()
            ).rename(draft, target, options)
        return True
    except Exception as error:  # py4j wraps both file systems' own exceptions
        if "FileAlreadyExists" in str(error):
            return False
        raise
    finally:
        fs.delete(draft, False)


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers taken so far, in order: one short name per commit."""
    where, fs = _fs(spark, folder)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(where, "[0-9]*")) or []
    return sorted(int(s.getPath().getName()) for s in found)


def content(spark: SparkSession, folder: str, number: int) -> str:
    where, fs = _fs(spark, folder)
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(where, f"{number:0{DIGITS}d}"))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def claim(spark: SparkSession, folder: str, subject: str = "", based_on: int | None = None, tries: int = 1000) -> int:
    """Take the next number, with ``subject`` as its content.

    A number that somebody else takes first is tried again one higher, after rereading. With
    ``based_on``, the number up to which the caller knows the state, a commit with the same
    subject above it is a ``CommitConflict``; the check and the claim are one step, as a commit that comes between
    takes the number.
    """
    checked = based_on if based_on is not None else 0
    for _ in range(tries):
        taken = numbers(spark, folder)
        last = taken[-1] if taken else 0
        if based_on is not None:
            for number in (n for n in taken if n > checked):
                if content(spark, folder, number) == subject:
                    raise CommitConflict(f"{subject} was committed as {number}, after {based_on}")
            checked = max(checked, last)
        if _write_once(spark, folder, f"{last + 1:0{DIGITS}d}", subject):
            return last + 1
    raise CommitConflict(f"no number was free in {tries} tries in {folder}")
