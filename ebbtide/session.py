"""Session settings and the shared folder for intermediate tables."""

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(name="ebbtide", cpus=8, partitions=8):
    """Session for tests and benchmarks on one machine; clusters bring their own."""
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
         .config("spark.sql.shuffle.partitions", str(partitions))
         .config("spark.driver.memory", "8g"))
    for key, val in SETTINGS.items():
        b = b.config(key, val)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark):
    """Folder that all executors can reach, as named by spark.checkpoint.dir. Only a local
    session may fall back to a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="ebbtide-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name="step"):
    """Write the rows once to the shared folder and read them back: later passes neither
    repeat the work nor depend on executors that may be gone."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark, path):
    """(Hadoop file system, path) of any store that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def create_file(spark, path, data):
    """Bytes to a new file, whole or not at all; False if the file is there already. Of several
    writers one succeeds: by a hard link in a local folder, elsewhere by a rename that refuses an
    existing target (atomic on HDFS and stores like it)."""
    fs, place = file_system(spark, path)
    jvm = spark._jvm.org.apache.hadoop.fs
    draft = jvm.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft)
    out.write(bytearray(data))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), place.toUri().getPath())
        else:
            options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
            options[0] = jvm.Options.Rename.NONE
            jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, place, options)
    except FileExistsError:
        return False
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(draft, False)
    return True


def read_file(spark, path):
    """Text of a small file."""
    fs, place = file_system(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def file_times(spark, folder):
    """{name in a folder: seconds since 1970 of its last change}, empty if it does not exist."""
    fs, place = file_system(spark, folder)
    if not fs.exists(place):
        return {}
    return {f.getPath().getName(): f.getModificationTime() / 1000 for f in fs.listStatus(place)}


def drop_path(spark, path):
    fs, place = file_system(spark, path)
    fs.delete(place, True)
