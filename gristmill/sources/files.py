"""Small steps on the file system of a path, through Hadoop: any that Spark reads and writes."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path, and the path in full. On local disks it is the plain one, which writes no checksums beside files."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
    full = fs.makeQualified(own)
    return fs.getRawFileSystem() if full.toUri().getScheme() == "file" else fs, full


def child(spark: SparkSession, folder: JavaObject, name: str) -> JavaObject:
    return spark._jvm.org.apache.hadoop.fs.Path(folder, name)


def listed(fs: JavaObject, folder: JavaObject) -> list[JavaObject]:
    """What a folder holds, by name; nothing if there is none."""
    return sorted(fs.listStatus(folder), key=lambda f: f.getPath().getName()) if fs.exists(folder) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, own = at(spark, path)
    out = fs.create(own, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, own = at(spark, path)
    stream = fs.open(own)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def join(spark: SparkSession, fs: JavaObject, target: JavaObject, head: str, parts: list[JavaObject], less: int, tail: str) -> None:
    """Writes head, the bytes of all parts but the last `less` of them, and tail. Bytes are copied by the JVM in blocks."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = fs.create(target, True)
    try:
        out.write(bytearray(head.encode()))
        for i, part in enumerate(parts):
            stream = fs.open(part.getPath())
            if i + 1 == len(parts):
                stream = jvm.org.apache.commons.io.input.BoundedInputStream(stream, part.getLen() - less)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            finally:
                stream.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()


def replace(spark: SparkSession, fs: JavaObject, source: JavaObject, target: JavaObject) -> None:
    """Renames a file over another one, if there is one, in one step where the file system can."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(source, target, over)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with this text, all at once, unless there is one; tells whether it did.

    Of several writers one succeeds: the file is complete when it gets its name, and a name is given once
    (a rename without overwriting, which is one step on HDFS; a hard link on local disks).
    """
    fs, own = at(spark, path)
    draft = child(spark, own.getParent(), f".{own.getName()}-{os.urandom(8).hex()}")
    write_text(spark, draft.toString(), text)
    jvm = spark._jvm
    try:
        if draft.toUri().getScheme() == "file":
            jvm.java.nio.file.Files.createLink(jvm.java.io.File(own.toUri().getPath()).toPath(), jvm.java.io.File(draft.toUri().getPath()).toPath())
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, own, none)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(draft, False)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, in spark.checkpoint.dir; it goes when the session's JVM ends.

    Without that setting there is one only where all of Spark runs on one machine (tests).
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.gettempdir()
    fs, folder = at(spark, f"{own}/gristmill-{name}-{uuid.uuid4()}")
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return folder.toString()
