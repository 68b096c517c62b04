"""A chat server's channel history as a batch source, page by page.

    spark.dataSource.register(ChannelHistory)
    spark.read.format("channel_history").option("pages", "module:function").option("channels", "a,b").load()

`module:function` names a callable (channel, page, per_page) -> list of message dicts; the REST client stays outside.
Each channel is a partition, so channels are read side by side."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = ["id", "message", "user_id", "create_at", "channel_id", "type", "hashtags", "root_id"]


class ChannelHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "channel_history"

    def schema(self) -> str:
        return "id string, message string, user_id string, create_at long, channel_id string, type string, hashtags string, root_id string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(c) for c in self.options["channels"].split(",")]

    def read(self, partition):
        module, _, function = self.options["pages"].partition(":")
        fetch = getattr(import_module(module), function)
        size, page = int(self.options.get("per_page", 200)), 0
        while posts := fetch(partition.value, page, size):
            for post in posts:
                if (post.get("message") or "").strip():
                    yield tuple(post.get(f) for f in FIELDS)
            if len(posts) < size:
                return
            page += 1
