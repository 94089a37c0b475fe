"""Chat formatting: conversations rebuilt from an event log, then rendered.

An event is (conv_id, seq, turn, role, kind, text):

* ``message``: one complete turn;
* ``delta``: text to append to the streamed turn ``turn``;
* ``edit``: replaces what the turn had and drops every later turn written before it;
* ``regenerate``: empties the turn and drops every later turn written before it.

The fold needs no loop: an event is live unless a later edit or regeneration
has a turn that is not greater. That is a suffix minimum over the log, taken
in blocks of ``BLOCK`` sequence numbers so that one long conversation spreads
over tasks: inside the block by a window, between blocks over one row a block.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
BLOCK = 4096
#: Turns that one rendered block holds.
TURNS = 256
RESETS = ("edit", "regenerate")


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\`` and ``<|`` becomes ``<\|``: no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    r"""Inverse of :func:`escape`: every ``\`` there starts a pair."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    r"""As :func:`escape`, and a line feed becomes ``\n``, since one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, seq, role, text) of an event log.

    Null texts and roles are empty; a null turn or sequence sorts first and no
    edit reaches it; repeated ``message`` rows stay separate turns; a streamed
    turn has the role of its first live event. Other columns are ignored.
    """
    e = events.select("conv_id", "seq", "turn", F.coalesce("role", F.lit("")).alias("role"), "kind", F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("block", F.floor(F.col("seq") / BLOCK))
    reset = F.when(F.col("kind").isin(*RESETS), F.col("turn"))
    e = e.withColumn("reset", reset)
    inside = Window.partitionBy("conv_id", "block").orderBy(*(F.col(c).desc() for c in ("seq", "turn", "kind", "role", "text"))).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = e.groupBy("conv_id", "block").agg(F.min("reset").alias("low")).withColumn("beyond", F.min("low").over(after)).where("beyond is not null").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "beyond")
    e = e.withColumn("within", F.min("reset").over(inside))
    e = e.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")), "left")
    live = e.where(~F.coalesce(F.least("within", "beyond") <= F.col("turn"), F.lit(False)))
    whole = live.where("kind = 'message'").select("conv_id", "turn", "seq", "role", "text")
    parts = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    streamed = live.where("kind <> 'message'").groupBy("conv_id", "turn").agg(parts.alias("p")).select("conv_id", "turn", F.col("p")[0]["seq"].alias("seq"), F.col("p")[0]["role"].alias("role"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return whole.unionByName(streamed)


def render(messages: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: (conv_id, n_turns, formatted, blocks).

    ``formatted`` holds the turns in order of (turn, seq, role, text) as
    ``<|im_start|>role LF text <|im_end|> LF`` with escaped roles and texts.
    ``blocks`` describes it piece by piece: ``chars`` of a piece and ``spans``
    (start inside the piece, chars) of the escaped texts under the loss mask,
    those of roles ``learn_from``. Turns meet in blocks of ``TURNS`` first, so
    a long conversation is put together from few strings.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    m = messages.select("conv_id", F.floor(F.col("turn") / TURNS).alias("block"), F.struct("turn", "seq", "role", "text", head.alias("head"), body.alias("body")).alias("m"))
    m = m.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    piece = F.array_join(F.transform("ms", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    sizes = F.transform("ms", lambda x: F.struct(F.length(x["head"]).alias("head"), F.length(x["body"]).alias("body"), x["role"].isin(*learn_from).alias("loss")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        span = F.array(F.struct((acc["at"] + x["head"]).alias("start"), x["body"].alias("chars")))
        return F.struct((acc["at"] + x["head"] + x["body"] + len(END)).alias("at"), F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(sizes, zero, step, lambda acc: acc["spans"])
    m = m.select("conv_id", F.struct("block", F.size("ms").alias("n"), piece.alias("piece"), spans.alias("spans")).alias("b"))
    m = m.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    return m.select(
        "conv_id",
        F.aggregate("bs", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_turns"),
        F.array_join(F.transform("bs", lambda b: b["piece"]), "").alias("formatted"),
        F.transform("bs", lambda b: F.struct(F.length(b["piece"]).alias("chars"), b["spans"].alias("spans"))).alias("blocks"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, learned): the turns parsed out of
    ``formatted`` and the unescaped texts that the loss mask covers."""
    starts = F.aggregate("blocks", F.array(F.lit(1)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b["chars"])))
    r = rendered.select("conv_id", "formatted", "blocks", starts.alias("starts"))
    cut = F.transform(F.arrays_zip("blocks", "starts"), lambda z: F.struct(F.substring(F.col("formatted"), z["starts"], z["blocks"]["chars"]).alias("piece"), z["blocks"]["spans"].alias("spans")))
    r = r.select("conv_id", "formatted", F.filter(cut, lambda z: z["piece"].isNotNull()).alias("cut"))

    def turns(z: Column) -> Column:
        whole = F.filter(F.split(z["piece"], r"<\|im_end\|>\n"), lambda t: t != "")
        parse = lambda t: F.struct(unescape_role(F.regexp_extract(t, r"(?s)^<\|im_start\|>(.*?)\n", 1)).alias("role"), unescape(F.regexp_extract(t, r"(?s)^[^\n]*\n(.*)$", 1)).alias("text"))
        return F.transform(whole, parse)

    masked = lambda z: F.transform(z["spans"], lambda s: unescape(F.substring(z["piece"], s["start"] + 1, s["chars"])))
    return r.select("conv_id", "formatted", F.flatten(F.transform("cut", turns)).alias("turns"), F.flatten(F.transform("cut", masked)).alias("learned"))
