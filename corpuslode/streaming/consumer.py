"""A consumer group over a folder of messages, and state with timers: quiet paths, rebuilds, newer copies.

The group lives beside the log, not in a query's checkpoint. A batch is a numbered list of files that the group has been
given; it is acknowledged once a query has committed it. A query that starts anew takes the batches that were given and not
acknowledged first, then new files; so nothing is lost and only what was pending comes twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class _Group:
    """The files of a consumer group: groups/NAME/given/N.json, a batch each, and groups/NAME/acked/N, empty."""

    def __init__(self, path: str, group: str) -> None:
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.at = f"{self.base}/_groups/{group}"
        for d in ("given", "acked"):
            self.fs.create_dir(f"{self.at}/{d}", recursive=True)

    def _names(self, folder: str) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [x.base_name for x in found if x.type == fs.FileType.File]

    def log(self) -> list[str]:
        """The finished files of the log."""
        return sorted(n for n in self._names(self.base) if not n.startswith(("_", ".")))

    def numbers(self, folder: str) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.at}/{folder}") if n.removesuffix(".json").isdigit())

    def acked(self) -> int:
        return max(self.numbers("acked"), default=0)

    def given(self, number: int) -> list[str]:
        with self.fs.open_input_stream(f"{self.at}/given/{number}.json") as f:
            return json.loads(f.read())

    def give(self, most: int) -> int:
        """The number of the last batch, a new one of up to `most` files if there are any."""
        numbers = self.numbers("given")
        taken = {n for k in numbers for n in self.given(k)}
        new = [n for n in self.log() if n not in taken][:most]
        last = max(numbers, default=0)
        if new:
            last += 1
            part = f"{self.at}/.{uuid.uuid4().hex}"
            with self.fs.open_output_stream(part) as f:
                f.write(json.dumps(new).encode())
            self.fs.move(part, f"{self.at}/given/{last}.json")
        return last

    def ack(self, number: int) -> None:
        with self.fs.open_output_stream(f"{self.at}/acked/{number}"):
            pass


class _File(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.name, self.most = options["path"], options.get("group", "default"), int(options.get("files_per_batch", "100"))
        self.group = _Group(self.path, self.name)
        self.started = False

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "group"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.group = _Group(self.path, self.name)

    def initialOffset(self) -> dict:
        return {"batch": self.group.acked()}

    def latestOffset(self, *limits: object) -> dict:
        if not self.started:  # pending batches come before any new file
            self.started = True
            last = max(self.group.numbers("given"), default=0)
            if last > self.group.acked():
                return {"batch": last}
        return {"batch": self.group.give(self.most)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(n) for k in range(start["batch"] + 1, end["batch"] + 1) for n in self.group.given(k)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with self.group.fs.open_input_stream(f"{self.group.base}/{partition.name}") as f:
            for i, line in enumerate(f.read().decode("utf-8", "replace").splitlines()):
                if line:
                    yield f"{partition.name}:{i}", line

    def commit(self, end: dict) -> None:
        self.group.ack(end["batch"])


class MessageLog(DataSource):
    """readStream.format("message_log") with path, group and files_per_batch: (source, raw), a line of a file each."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return "source string, raw string"

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def consumed(spark: SparkSession, path: str, group: str, files_per_batch: int = 100) -> DataFrame:
    """(source, raw) of the messages of the log at path that the group has not acknowledged, pending ones first."""
    spark.dataSource.register(MessageLog)
    return spark.readStream.format("message_log").option("path", path).option("group", group).option("files_per_batch", files_per_batch).load()


def acknowledge(path: str, group: str) -> None:
    """Acknowledges all batches that the group was given; for a query that has ended and committed them."""
    own = _Group(path, group)
    last = max(own.numbers("given"), default=0)
    if last > own.acked():
        own.ack(last)


def settled(events: DataFrame, quiet_ms: int = 1000) -> DataFrame:
    """(path, events) of events (path), once a path has had none for quiet_ms: a flush after the last one, not the first."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "events": [n]})
            return
        n = (state.get[0] if state.exists else 0) + sum(map(len, pdfs))
        state.update((n,))
        state.setTimeoutDuration(quiet_ms)

    return events.groupBy("path").applyInPandasWithState(run, "path string, events long", "events long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def rebuilds(messages: DataFrame, count: int = 10, idle_ms: int = 5000) -> DataFrame:
    """(reason, messages): `count` as soon as that many messages have come since the last one, else `idle` after a pause.

    Tasks hand on their numbers of messages, not the messages, so the one key's group is a row a task.
    """

    def counted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = sum(map(len, it))
        if n:
            yield pd.DataFrame({"of": ["index"], "n": [n]})

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"reason": ["idle"], "messages": [n]})
            return
        n += int(sum(pdf["n"].sum() for pdf in pdfs))
        if n >= count:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"reason": ["count"], "messages": [n]})
        elif n:
            state.update((n,))
            state.setTimeoutDuration(idle_ms)

    rows = messages.mapInPandas(counted, "of string, n long")
    return rows.groupBy("of").applyInPandasWithState(run, "reason string, messages long", "messages long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def newer(documents: DataFrame, keep_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """(content_hash, doc_id, replaced) of documents (content_hash, doc_id): the copy that it takes the place of, if one came.

    A hash is forgotten once none of its copies has come for keep_ms, so state does not grow for ever.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old, out = state.get[0] if state.exists else None, []
        for pdf in pdfs:
            for doc in sorted(pdf["doc_id"]):
                if doc != old:
                    out.append((key[0], doc, old))
                    old = doc
        state.update((old,))
        state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=["content_hash", "doc_id", "replaced"])

    kind = "content_hash string, doc_id string, replaced string"
    return documents.select("content_hash", F.col("doc_id").cast("string").alias("doc_id")).groupBy("content_hash").applyInPandasWithState(run, kind, "doc_id string", "append", GroupStateTimeout.ProcessingTimeTimeout)
