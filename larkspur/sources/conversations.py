"""Conversation formats, session views and chunks. Inputs are tables of whole files: (path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def file_format(path: Column, content: Column) -> Column:
    """jsonl, tree, team or plain, by extension and a look at the content."""
    ext = extension(path)
    return F.when(ext == ".jsonl", "jsonl").when((ext == ".json") & content.contains("mapping"), "tree").when((ext == ".json") & content.contains('"messages"'), "team").otherwise("plain")


def text_of(value: Column) -> Column:
    """A JSON value's string, if it is one."""
    return F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string"))


def parse_lines(files: DataFrame) -> DataFrame:
    """One message a line: (path, turn, speaker, content, ts). Content is a string, or a list of parts whose texts are
    joined by spaces. Lines that aren't JSON objects, or lack a role or content, are passed over."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "raw")).withColumn("v", F.try_parse_json(F.trim("raw"))).filter("v is not null")
    get = lambda p, t: F.try_variant_get("v", p, t)
    plain = F.when(F.schema_of_variant(F.try_variant_get("v", "$.content", "variant")) == "STRING", get("$.content", "string"))
    parts = F.filter(F.transform(get("$.content", "array<variant>"), lambda x: text_of(F.try_variant_get(x, "$.text", "variant"))), lambda x: x.isNotNull())
    text = F.coalesce(F.when(plain != "", plain), F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " "), F.lit(" "))), F.lit(""))
    role = text_of(F.try_variant_get("v", "$.role", "variant"))
    out = lines.select("path", "line", role.alias("speaker"), text.alias("content")).filter("speaker <> '' and content <> ''")
    return numbered(out.select("path", F.col("line").cast("long").alias("at"), "speaker", F.trim("content").alias("content"), F.lit("").alias("ts")))


def numbered(rows: DataFrame) -> DataFrame:
    """Turns from 0 in the order of at."""
    turn = F.row_number().over(W.partitionBy("path").orderBy("at")) - 1
    return rows.withColumn("turn", turn.cast("long")).select("path", "turn", "speaker", "content", "ts")


def parse_tree(files: DataFrame) -> DataFrame:
    """A tree of message nodes; string parts are joined without a separator. Nodes come in the order of their creation
    times, then keys (the format itself has no order of a map's nodes); those without an author are passed over."""
    v = files.withColumn("v", F.try_parse_json("content")).select("path", F.explode(F.map_entries(F.try_variant_get("v", "$.mapping", "map<string,variant>"))).alias("e"))
    get = lambda p: F.try_variant_get("e.value", p, "variant")
    parts = F.filter(F.transform(F.try_variant_get("e.value", "$.message.content.parts", "array<variant>"), text_of), lambda x: x.isNotNull())
    rows = v.select("path", F.struct(F.coalesce(F.try_variant_get("e.value", "$.message.create_time", "double"), F.lit(0.0)), F.col("e.key")).alias("at"), text_of(get("$.message.author.role")).alias("speaker"), F.array_join(parts, "").alias("content"))
    return numbered(rows.filter("speaker <> '' and content <> ''").withColumn("ts", F.lit("")))


def parse_team(files: DataFrame) -> DataFrame:
    """A list of messages, or an object that holds one; a message needs a text, its user may be unknown."""
    v = F.try_parse_json("content")
    messages = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.messages", "array<variant>"))
    rows = files.select("path", F.posexplode(messages).alias("at", "m"))
    get = lambda p: text_of(F.try_variant_get("m", p, "variant"))
    user = get("$.user")
    rows = rows.select("path", "at", F.coalesce(F.when(user != "", user), F.lit("unknown")).alias("speaker"), get("$.text").alias("content"), F.coalesce(get("$.ts"), F.lit("")).alias("ts"))
    return numbered(rows.filter("content <> ''"))


def parse_plain(files: DataFrame) -> DataFrame:
    """A transcript: a line with a speaker's prefix starts a turn, further non-blank lines go on with it, lines before
    the first speaker are dropped. Prefixes are case-sensitive."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "raw")).withColumn("t", F.trim("raw"))
    speaker = F.when(F.col("t").rlike("^(Human|User):"), "human").when(F.col("t").rlike("^(Assistant|AI):"), "assistant")
    lines = lines.withColumn("speaker", speaker).withColumn("text", F.trim(F.regexp_replace("t", "^(Human:|User:|Assistant:|AI:)", "")))
    lines = lines.withColumn("turn", F.count("speaker").over(W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0)) - 1)
    lines = lines.filter((F.col("turn") >= 0) & (F.col("speaker").isNotNull() | (F.col("t") != "")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x.text), "\n")
    return lines.groupBy("path", "turn").agg(F.max("speaker").alias("speaker"), text.alias("content")).select("path", "turn", "speaker", "content", F.lit("").alias("ts"))


def parse(files: DataFrame) -> DataFrame:
    """Turns of files of any of the formats."""
    kind = file_format(F.col("path"), F.col("content"))
    out = None
    for name, parser in (("jsonl", parse_lines), ("tree", parse_tree), ("team", parse_team), ("plain", parse_plain)):
        part = parser(files.filter(kind == name))
        out = part if out is None else out.unionByName(part)
    return out


def views(turns: DataFrame, key: str = "conv_id", users: tuple[str, ...] = ("user", "human"), ignore_case: bool = True) -> DataFrame:
    """Rows (key, hall, content): L0 all turns with their speakers, L1 the user's turns, L2 the first three of those;
    lines in order; empty views are left out. Input: (key, turn, speaker, content)."""
    speaker = F.lower("speaker") if ignore_case else F.col("speaker")
    line = F.struct("turn", F.concat_ws(": ", F.coalesce("speaker", F.lit("")), F.coalesce("content", F.lit(""))).alias("all"), F.when(speaker.isin(*users), F.coalesce("content", F.lit(""))).alias("own"))
    sorted_lines = F.sort_array(F.collect_list(line))
    out = turns.groupBy(key).agg(sorted_lines.alias("lines"))
    own = F.filter(F.transform("lines", lambda x: x.own), lambda x: x.isNotNull())
    halls = F.array(
        F.struct(F.lit("L0").alias("hall"), F.array_join(F.transform("lines", lambda x: x["all"]), "\n").alias("content")),
        F.struct(F.lit("L1").alias("hall"), F.array_join(own, "\n").alias("content")),
        F.struct(F.lit("L2").alias("hall"), F.array_join(F.slice(own, 1, 3), "\n").alias("content")),
    )
    return out.select(key, F.inline(halls)).filter("content <> ''")


def whole_sessions(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows (key, content): a session as one text."""
    return views(turns, key).filter("hall = 'L0'").select(key, "content")


def chunks(messages: DataFrame, size: int, key: str = "session") -> DataFrame:
    """Rows (key, chunk, content, source_file: the messages' ids, comma-separated) of so many messages each; messages
    (key, position, id, speaker, text, caption or null, query or null). Chunks under five bytes are dropped."""
    place = F.floor((F.row_number().over(W.partitionBy(key).orderBy("position")) - 1) / size)
    note = lambda c, name: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f" [{name}: "), F.col(c), F.lit("]"))).otherwise("")
    line = F.concat(F.col("speaker"), F.lit(": "), F.coalesce("text", F.lit("")), note("caption", "image"), note("query", "query"))
    rows = messages.withColumn("chunk", place).select(key, "chunk", F.struct("position", line.alias("line"), "id").alias("m")).groupBy(key, "chunk").agg(F.sort_array(F.collect_list("m")).alias("m"))
    out = rows.select(key, "chunk", F.array_join(F.transform("m", lambda x: x.line), "\n").alias("content"), F.array_join(F.transform("m", lambda x: x.id), ",").alias("source_file"))
    return out.filter(F.octet_length("content") >= 5)


def packed_words(text: Column, most: int) -> Column:
    """A text's words packed greedily into pieces of at most that many characters; a longer word is a piece."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    step = lambda s, w: F.when(s.now == "", F.struct(s.done.alias("done"), w.alias("now"))).when(
        F.length(s.now) + 1 + F.length(w) > most, F.struct(F.array_append(s.done, s.now).alias("done"), w.alias("now"))
    ).otherwise(F.struct(s.done.alias("done"), F.concat(s.now, F.lit(" "), w).alias("now")))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.aggregate(words, start, step, lambda s: F.when(s.now != "", F.array_append(s.done, s.now)).otherwise(s.done))


def session_number(name: Column) -> Column:
    """The number of a key session_N; null for other keys."""
    return F.regexp_extract(name, r"^session_(\d+)$", 1).try_cast("int")
