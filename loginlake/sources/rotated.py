"""Writes derived log lines as folders of rotated files, some of them damaged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import filesystem
from .integrity import PIECE_BYTES

DAMAGED = "auth.log.2.gz"


def _hadoop(spark: SparkSession, folder: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    return context, path, path(folder).getFileSystem(context._jsc.hadoopConfiguration())


def write_rotated(lines: DataFrame, folder: str) -> None:
    """lines (value, file_name, seq) as files of their names; every second rotated one is zipped.

    Tasks write ranges of (file_name, seq), so that a day's lines may fill several files of bounded
    size; the second and further ones of a name lie in folders of their own, as those of other machines do.
    """
    context, path, files = _hadoop(lines.sparkSession, folder)
    rank = F.try_element_at(F.split("file_name", r"\."), F.lit(3)).try_cast("int")
    zipped = F.coalesce(rank % 2 == 0, F.lit(False))
    for codec, part in (("gzip", lines.filter(zipped)), ("none", lines.filter(~zipped))):
        staged = f"{folder}/.staged-{codec}"
        rows = part.repartitionByRange("file_name", "seq").sortWithinPartitions("file_name", "seq")
        rows.select("file_name", "value").write.partitionBy("file_name").option("compression", codec).text(staged)
        for day in files.listStatus(path(staged)):
            if day.isDirectory():
                name = day.getPath().getName().removeprefix("file_name=") + (".gz" if codec == "gzip" else "")
                written = sorted((f.getPath() for f in files.listStatus(day.getPath())), key=lambda p: p.getName())
                for n, file in enumerate(written):
                    home = folder if n == 0 else f"{folder}/more-{n}"
                    files.mkdirs(path(home))
                    files.rename(file, path(f"{home}/{name}"))
        files.delete(path(staged), True)
    damaged = path(f"{folder}/{DAMAGED}")
    if files.exists(damaged):
        whole = path(f"{folder}/.whole-{DAMAGED}")
        files.rename(damaged, whole)
        source, target = files.open(whole), files.create(damaged, True)
        context._jvm.org.apache.commons.io.IOUtils.copyLarge(source, target, 0, files.getFileStatus(whole).getLen() // 2)
        source.close()
        target.close()
        files.delete(whole, False)


def _damage(part: tuple[str, str]) -> None:
    """Writes the damaged forms of one gzip file, read in pieces, into a folder."""
    source, home = part
    files, whole = filesystem(source)
    size = files.get_file_info(whole).size
    _, home = filesystem(home)
    files.create_dir(home, recursive=True)

    def write(name: str, *stretches: tuple[int, int]) -> None:
        with files.open_output_stream(f"{home}/{name}", compression=None) as out:
            for start, length in stretches:
                with files.open_input_file(whole) as stream:
                    stream.seek(start)
                    while piece := stream.read(min(PIECE_BYTES, length)):
                        out.write(piece)
                        length -= len(piece)

    write("auth.log.1.gz", (0, size), (0, size))
    write("auth.log.2.gz", (0, size // 2))
    write("auth.log.3.gz", (0, size), (5, size // 2))
    write("auth.log.4.gz", (5, size // 2))
    write("auth.log.5")
    write("auth.log.6.gz")


def write_damaged(lines: DataFrame, folder: str) -> None:
    """All lines (value, file_name, seq) as gzip files, and from each of these: two members (1.gz), cut short (2.gz),
    followed by other bytes (3.gz), no gzip at all (4.gz), no bytes (5, 6.gz).

    As in write_rotated a file holds a range of (file_name, seq); the damaged forms of each are made by a task of their
    own, those of the second and further ones in folders of their own.
    """
    context, path, files = _hadoop(lines.sparkSession, folder)
    staged = f"{folder}/.staged-gzip"
    rows = lines.repartitionByRange("file_name", "seq").sortWithinPartitions("file_name", "seq")
    rows.select("value").write.option("compression", "gzip").text(staged)
    written = sorted(str(f.getPath()) for f in files.listStatus(path(staged)) if f.getPath().getName().endswith(".gz"))
    home = str(files.makeQualified(path(folder)))
    parts = [(file, home if n == 0 else f"{home}/more-{n}") for n, file in enumerate(written)]
    context.parallelize(parts, len(parts)).foreach(_damage)
    files.delete(path(staged), True)
