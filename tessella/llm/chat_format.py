r"""Chat formatting with a grammar round trip.

A conversation is rendered as blocks ``<|im_start|>ROLE\nTEXT<|im_end|>\n``.  A deterministic parser
reads the rendering back; turns that do not come back as they were are escaped and rendered again
until they do.

Grammar of a rendering, in which nothing else may stand between blocks::

    rendering = { "<|im_start|>" role "\n" text "<|im_end|>" "\n" }
    role      = no newline;   text = no control string, that is nothing like "<|word|>"

Escaping puts one more backslash between ``<`` and ``|`` wherever only backslashes (or nothing)
stand between them: ``<|`` becomes ``<\|`` and ``<\|`` becomes ``<\\|``.  Reading takes one away
again, so every text can be written, and a text without these strings is written as it is.  In
roles, a backslash becomes ``\\``, a newline ``\n`` and ``<`` becomes ``\l``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: One block, for the parser.
BLOCK = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"
#: What no text may hold as it is.
CONTROL = r"<\|\w+\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("<"), F.lit("\\l"))


def _role_in(role: Column) -> Column:
    # Split at escaped backslashes, which keeps them apart from the letter after them.
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<"))), "\\")


def _block(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), _role_out(role), F.lit("\n"), body, F.lit(END))


def parse(rendered: Column) -> Column:
    """array<struct<role, text>> of a rendering; null if it does not follow the grammar."""
    roles = F.regexp_extract_all(rendered, F.lit(BLOCK), F.lit(1))
    texts = F.regexp_extract_all(rendered, F.lit(BLOCK), F.lit(2))
    turns = F.arrays_zip(roles.alias("role"), texts.alias("text"))
    used = F.aggregate(turns, F.lit(0), lambda n, t: n + F.length(t["role"]) + F.length(t["text"]) + F.lit(len(START) + 1 + len(END)))
    read = F.transform(turns, lambda t: F.struct(_role_in(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    return F.when((used == F.length(rendered)) & ~F.exists(texts, lambda t: F.rlike(t, F.lit(CONTROL))), read)


def render(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format conversations; ``turns`` has conv_id, turn, role, text.

    Returns one row per conv_id: formatted, spans (array of (start, size), in code points of
    formatted, of the texts under the loss mask), n_escaped (turns that had to be escaped).

    Turns come in the order of turn, null first, then of role and text; rows that repeat a turn are
    each a turn.  A null role or text counts as empty.  A null conv_id is a conversation of its own.
    An empty table gives no rows.  Other columns are not read.  A conversation is one output row, so
    its turns meet in one task; everything before that is done turn by turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    # First rendering: as it is.  A turn whose own block reads back as that one turn cannot disturb
    # its neighbours, since it holds no control string of its own.
    back = parse(_block(F.col("role"), F.col("text")))
    same = (F.size(back) == 1) & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text"))
    turn = turn.withColumn("fits", F.coalesce(same, F.lit(False)))
    # Second rendering: conflicting texts escaped; what escape() gives holds no control string.
    turn = turn.withColumn("body", F.when(F.col("fits"), F.col("text")).otherwise(escape(F.col("text"))))
    turn = turn.select(
        "conv_id",
        F.struct(
            "turn", "role", "text", "fits", "body",
            F.length(_block(F.col("role"), F.col("body"))).alias("size"),
            (F.length(_role_out(F.col("role"))) + len(START) + 1).alias("head"),
        ).alias("t"),
    )
    conv = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    conv = conv.withColumn("formatted", F.array_join(F.transform("turns", lambda t: _block(t["role"], t["body"])), ""))
    nothing = F.expr("CAST(array() AS array<struct<start:int,size:int>>)")
    walked = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), nothing.alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["size"]).alias("at"),
            F.when(
                t["role"].isin(*loss_roles),
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["head"]).alias("start"), F.length(t["body"]).alias("size")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = conv.select(
        "conv_id",
        F.when(parse(F.col("formatted")).eqNullSafe(source), F.col("formatted"))
        .otherwise(F.raise_error(F.lit("a conversation does not read back as it was")))
        .alias("formatted"),
        walked["spans"].alias("spans"),
        F.size(F.filter("turns", lambda t: ~t["fits"])).alias("n_escaped"),
    )
    return out


def digest_of_rendering(rendered: DataFrame) -> DataFrame:
    """What the renderings say, read back from them and their spans alone."""
    turns = parse(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["size"]))), "")
    read = rendered.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        under.alias("under"), F.length("formatted").cast("long").alias("formatted_chars"), F.col("n_escaped").cast("long").alias("n_escaped"),
    )
    return read.select(
        "conv_id", "n_turns", "turns_sha256", F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"), "formatted_chars", "n_escaped",
    )
