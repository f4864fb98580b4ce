"""Paths in any file system that the session reads."""

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _system(spark, path)
    return system.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """The entries of a folder, sorted; none if there is no such folder."""
    system, at = _system(spark, path)
    if not system.exists(at):
        return []
    names = (s.getPath().toString() for s in system.listStatus(at))
    return sorted(n for n in names if not n.rpartition("/")[2].startswith(("_", ".")))


def modified(spark: SparkSession, path: str) -> int:
    """When a file, or the newest entry of a folder, was last written."""
    system, at = _system(spark, path)
    status = system.getFileStatus(at)
    inner = [s.getModificationTime() for s in system.listStatus(at)] if status.isDirectory() else []
    return max([status.getModificationTime(), *inner])


def delete(spark: SparkSession, path: str) -> None:
    system, at = _system(spark, path)
    system.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    system, at = _system(spark, path)
    stream = system.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new small file; False if there is one of that name, which stays as it is."""
    system, at = _system(spark, path)
    try:
        stream = system.create(at, False)
    except Exception as taken:
        if "AlreadyExists" in str(taken) or "already exists" in str(taken):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def rename_new(spark: SparkSession, path: str, target: str) -> bool:
    """Rename in one step; False, with ``path`` deleted, if there is a ``target`` already."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    old, new = fs.Path(path), fs.Path(target)
    system, _ = _system(spark, path)
    context = fs.FileContext.getFileContext(system.makeQualified(old).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(system.makeQualified(old), system.makeQualified(new), gateway.new_array(fs.Options.Rename, 0))
    except Exception as taken:
        if "FileAlreadyExists" in str(taken) or "already exists" in str(taken):
            delete(spark, path)
            return False
        raise
    return True
