"""TOML files as a Spark data source: ``spark.dataSource.register(TomlSource)``, then ``spark.read.format("toml").load(folder)``.

Files are listed once by the driver's Spark, runs of them are the partitions, and the tasks open them through Arrow's file systems. Conditions ``key = ...``,
``key in (...)`` and ``key like 'begin%'`` are pushed to the reader with the option ``pushKeys``: other leaves are never made into rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith


def leaves(value, at: str = ""):
    """(key, value) of every leaf, keys with dots and places in lists from 0."""
    pairs = value.items() if isinstance(value, dict) else enumerate(value)
    for k, v in pairs:
        name = f"{at}.{k}" if at else str(k)
        if isinstance(v, (dict, list)):
            yield from leaves(v, name)
        else:
            yield name, str(v)


@dataclass
class Files(InputPartition):
    paths: list


class TomlReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.glob, self.run = options["path"], options.get("pathglobfilter", "*.toml"), int(options.get("filespertask", "64"))
        self.keys, self.begin = None, ""

    def partitions(self):
        import fnmatch

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder) if ":" in self.folder else (fs.LocalFileSystem(), self.folder)
        found = sorted(x.path for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.glob))
        return [Files(found[i : i + self.run]) for i in range(0, len(found), self.run)] or [Files([])]

    def read(self, partition):
        import tomllib

        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.folder)[0] if ":" in self.folder else fs.LocalFileSystem()
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                for key, value in leaves(tomllib.loads(f.read().decode())):
                    if (self.keys is None or key in self.keys) and key.startswith(self.begin):
                        yield path, key, value


class PushingTomlReader(TomlReader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",):
                self.keys = {f.value} if self.keys is None else self.keys & {f.value}
            elif isinstance(f, In) and f.attribute == ("key",):
                self.keys = set(f.value) if self.keys is None else self.keys & set(f.value)
            elif isinstance(f, StringStartsWith) and f.attribute == ("key",) and f.value.startswith(self.begin):
                self.begin = f.value
            else:
                yield f


class TomlSource(DataSource):
    """(path, key, value) of every leaf; options ``pathGlobFilter`` (*.toml), ``filesPerTask`` (64) and ``pushKeys`` (false), which needs ``spark.sql.python.filterPushdown.enabled``."""

    @classmethod
    def name(cls):
        return "toml"

    def schema(self):
        return "path string, key string, value string"

    def reader(self, schema):
        return (PushingTomlReader if self.options.get("pushkeys", "false") == "true" else TomlReader)(self.options)
