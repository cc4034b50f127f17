"""Tables in versions: who claims the next number first has made it, and nobody overwrites what another one reads."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid

from pyspark.sql import SparkSession


class Versions:
    """The versions of a table in a folder of any file system that Spark writes: small JSON files by number.

    A version is written under another name first, and then claimed by a rename that
    fails if the number is taken. Of two that claim the same number one wins; the
    other one reads the winner's version, and claims the next.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.jvm, self.folder = spark, spark._jvm, folder.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self.path("").getFileSystem(self.conf)
        self.local = self.files.getScheme() == "file"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions/{name}" if name else self.folder)

    def numbers(self) -> list[int]:
        versions = self.path("x").getParent()
        if not self.files.exists(versions):
            return []
        names = [x.getPath().getName() for x in self.files.listStatus(versions)]
        return sorted(int(x) for x in names if x.isdigit())

    def last(self) -> int:
        return max(self.numbers(), default=0)

    def read(self, number: int) -> dict:
        stream = self.files.open(self.path(f"{number:012d}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def claim(self, number: int, value: dict) -> bool:
        """Makes a version of a number, unless there is one."""
        part, whole = self.path(f".part-{uuid.uuid4().hex}"), self.path(f"{number:012d}")
        stream = self.files.create(part, False)
        stream.write(json.dumps(value).encode())
        stream.close()
        try:
            if self.local:  # a link is made once; a local rename would replace what is there
                os.link(part.toUri().getPath(), whole.toUri().getPath())
                return True
            options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.conf).rename(part, whole, options)
            return True
        except FileExistsError:
            return False
        except Exception:
            if self.files.exists(whole):
                return False
            raise
        finally:
            self.files.delete(part, False)

    def drop(self, name: str) -> None:
        """Deletes a table of the folder."""
        self.files.delete(self.path("").suffix(f"/{name}"), True)

    def tidy(self, keep: int = 2, age: dt.timedelta = dt.timedelta(hours=1)) -> None:
        """Deletes versions before the last ones that are so old that nobody reads them, and their tables."""
        before = dt.datetime.now(dt.UTC).timestamp() - age.total_seconds()
        for number in self.numbers()[:-keep]:
            path = self.path(f"{number:012d}")
            if self.files.getFileStatus(path).getModificationTime() / 1000 <= before:
                self.drop(self.read(number)["table"])
                self.files.delete(path, False)
