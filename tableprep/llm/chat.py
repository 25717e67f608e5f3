"""Chat formatting by a finite-state machine over roles (operator 7).

A declarative template lists, per role, the segments of a turn and which of
them carry loss. Control characters inside texts and roles are escaped by a
code that can be undone exactly, so no text can open, close or fake a turn.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

#: Escape codes. The backslash itself is escaped, so every
#: backslash in an escaped text begins a code, and undoing it last is exact.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"))

TEXT, ROLE = "{text}", "{role}"

#: Segments of a turn: (pattern, loss flag). ``*`` serves roles not listed.
TEMPLATE = {
    "assistant": (("<turn assistant>\n", False), (TEXT, True), ("</turn>\n", False)),
    "*": (("<turn " + ROLE + ">\n", False), (TEXT, False), ("</turn>\n", False)),
}
TURN_END = "</turn>\n"
TURN_OPEN, OPEN_END = "<turn ", ">\n"

#: Transitions of the role machine; what is not listed leads to ``error``.
MACHINE = {
    "start": {"system": "ready", "user": "asked"},
    "ready": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
ACCEPT = ("answered",)


def escape(c: Column) -> Column:
    for raw, code in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def turn_segments(role: Column, text: Column, template=TEMPLATE) -> Column:
    """The segments of one turn: array of (text, loss)."""
    def fill(pattern, loss):
        parts, rest = [], pattern
        while rest:
            at = min((rest.find(x) for x in (TEXT, ROLE) if x in rest), default=-1)
            if at < 0:
                parts.append(F.lit(rest))
                break
            if at:
                parts.append(F.lit(rest[:at]))
            slot = TEXT if rest.startswith(TEXT, at) else ROLE
            parts.append(escape(text if slot == TEXT else role))
            rest = rest[at + len(slot):]
        return F.struct((F.concat(*parts) if parts else F.lit("")).alias("text"), F.lit(loss).alias("loss"))

    out = F.array(*[fill(p, x) for p, x in template["*"]])
    for name, pieces in template.items():
        if name != "*":
            out = F.when(role == name, F.array(*[fill(p, x) for p, x in pieces])).otherwise(out)
    return out


def machine_state(roles: Column, machine=MACHINE) -> Column:
    """State after reading an array of roles."""
    table = F.create_map(*[F.lit(x) for s, t in machine.items() for r, to in t.items() for x in (f"{s} {r}", to)])
    return F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(table[F.concat_ws(" ", s, r)], F.lit("error")))


def format_chats(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 template=TEMPLATE, machine=MACHINE, accept=ACCEPT) -> DataFrame:
    """One row per conversation: ``conv``, ``n_turns``, ``state``, ``valid``, ``segments``, ``formatted``.

    ``segments`` is an array of (text, loss); ``formatted`` is their texts put
    together. Turns that break the role order are formatted all the same;
    ``state`` is ``error`` and ``valid`` false.

    Defined results: null text or role is empty; rows go by turn (null first),
    ties by role, then text, so repeated rows stay and the output does not
    depend on the order of the input; rows of a null conversation form one
    conversation; an empty table gives an empty result; other columns are not
    read. A conversation is one output string, so it is held by one task; the
    escaping is done before rows are brought together.
    """
    c = lambda name: F.col("`" + name.replace("`", "``") + "`")
    r, t = F.coalesce(c(role).cast("string"), F.lit("")), F.coalesce(c(text).cast("string"), F.lit(""))
    parts = rows.select(c(conv).alias(conv), F.struct(c(turn).alias("turn"), r.alias("role"), t.alias("text")).alias("key_"))
    parts = parts.select(c(conv), F.struct("key_.turn", "key_.role", "key_.text", turn_segments(
        F.col("key_.role"), F.col("key_.text"), template).alias("segments")).alias("part_"))
    # the struct sorts by turn, role, text; the segments follow from these
    chats = parts.groupBy(c(conv)).agg(F.sort_array(F.collect_list("part_")).alias("parts_"))
    state = machine_state(F.transform("parts_", lambda p: p["role"]), machine)
    chats = chats.select(c(conv), F.size("parts_").cast("long").alias("n_turns"), state.alias("state"),
                         F.flatten(F.transform("parts_", lambda p: p["segments"])).alias("segments"))
    return chats.select("*", F.col("state").isin(*accept).alias("valid"),
                        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """Turns read back from a formatted string of ``TEMPLATE``: array of (role, text).

    The marks hold ``<`` and ``>``, which no escaped text holds, so a literal
    split finds exactly the turns.
    """
    pieces = F.split(formatted, TURN_END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def one(p):
        at = F.instr(p, OPEN_END)
        return F.struct(unescape(F.substring(p, F.lit(len(TURN_OPEN) + 1), at - len(TURN_OPEN) - 1)).alias("role"),
                        unescape(F.substring(p, at + len(OPEN_END), F.length(p))).alias("text"))
    return F.transform(pieces, one)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


#: A conversation whose texts quote the template, added to every run.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op7_chat(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                 F.lit(r).alias("role"), F.lit(PROBE_TEXT).alias("text"))
        for i, r in enumerate(("user", "assistant"))])))
    chats = format_chats(rows.unionByName(probe))
    back = chats.select("*", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("learned"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "valid")


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, lag(role) OVER w AS prev
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn >' || chr(10) || '</turn>' || chr(10)) + length(role) + length(text)
           + length(regexp_replace(role || text, '[^\\<>]', '', 'g')))::BIGINT AS formatted_chars,
       bool_and(CASE WHEN role = 'system' THEN k = 1
                     WHEN role = 'user' THEN k = 1 OR prev IN ('system', 'assistant')
                     WHEN role = 'assistant' THEN k > 1 AND prev = 'user' ELSE false END
                AND (k < n OR role = 'assistant')) AS valid
FROM n GROUP BY conv_id
"""
