"""Mail as a source: messages to artifacts, and a data source that pulls a mailbox."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltwork.functions import text as T


def messages_to_artifacts(mails: DataFrame) -> DataFrame:
    """A row a message with text: what is registered of it, its hash and its clean text; messages without text are left out.

    ``mails`` has text, html, from_, subject, headers. The link of the article is preferred to the message id as URL,
    the list to the sender as source.
    """
    raw = T.body(F.col("text"), F.col("html"))
    # A generator is a barrier for the optimiser, which would write the whole chain of patterns out at every use of its result.
    rows = mails.select("*", F.explode(F.array(raw)).alias("raw")).select("*", F.explode(F.array(T.without_boilerplate(F.col("raw")))).alias("clean")).where(F.length("clean") > 0)
    message_id, list_id = T.header(F.col("headers"), "message-id"), T.header(F.col("headers"), "list-id")
    url = T.canonical_url(F.col("raw"))
    return rows.select(
        T.content_hash(F.col("clean")).alias("artifact_hash"), F.lit("email").alias("source_type"), F.col("from_").alias("author"),
        F.coalesce(T.filled(list_id), F.col("from_")).alias("source"), F.lit("text").alias("media"), F.col("subject").alias("title"),
        T.word_count(F.col("clean")).alias("word_count"), F.coalesce(url, message_id).alias("source_url"), message_id.alias("message_id"), list_id.alias("list_id"),
        url.alias("canonical_url"), F.col("clean").alias("text"),
    )


class MailboxSource(DataSource):
    """``spark.read.format("mailbox").option("path", …)``: messages of mbox-like folders of single .eml files, or with
    ``host``, ``user`` and ``password`` of an IMAP label, newest first up to ``limit``, without marking them read."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return "uid string, text string, html string, from_ string, subject string, date string, headers map<string,array<string>>"

    def reader(self, schema) -> DataSourceReader:
        return MailboxReader(dict(self.options))


class Part(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class MailboxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Part]:
        if "path" in self.options:
            from pathlib import Path

            names = sorted(str(p) for p in Path(self.options["path"]).rglob("*.eml"))
            step = max(1, int(self.options.get("messages", 500)))
            return [Part(names[i : i + step]) for i in range(0, len(names), step)] or [Part([])]
        return [Part([])]

    def read(self, part: Part) -> Iterator[tuple]:
        if "path" in self.options:
            for name in part.names:
                with open(name, "rb") as f:
                    yield row(name, f.read())
            return
        yield from self.pull()

    def pull(self) -> Iterator[tuple]:
        import imaplib

        with imaplib.IMAP4_SSL(self.options["host"]) as box:
            box.login(self.options["user"], self.options["password"])
            box.select(self.options.get("label", "INBOX"), readonly=True)
            uids = box.uid("search", None, "ALL")[1][0].split()
            for uid in list(reversed(uids))[: int(self.options.get("limit", 50))]:
                data = box.uid("fetch", uid, "(BODY.PEEK[])")[1]
                if data and isinstance(data[0], tuple):
                    yield row(uid.decode(), data[0][1])


def row(uid: str, data: bytes) -> tuple:
    """One message as a row of the source's schema."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    parts = {kind: m.get_body((kind,)) for kind in ("plain", "html")}
    text, html = (p.get_content() if p is not None else None for p in (parts["plain"], parts["html"]))
    headers: dict[str, list[str]] = {}
    for k, v in m.items():
        headers.setdefault(k.lower(), []).append(str(v))
    return uid, text, html, m["from"] and str(m["from"]), m["subject"] and str(m["subject"]), m["date"] and str(m["date"]), headers
