"""Which moments of a timeline reach the model, with what question and what context.

Rows have (timeline_id, t_sec, seq, kind, label): ``context`` adds to the rolling context, ``question`` leaves a question that waits for the next answer, ``visual`` and ``audio`` are candidates under one cooldown, ``force`` asks for an answer whatever the cooldown. At one time they come in this order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered, records, stateful
from tidemark.operators import timeline as TL

KINDS = ("context", "question", "visual", "audio", "force")
ASKED = "t_sec double, seq bigint, kind string, label string, question string, n_context bigint, span double"
# The questions asked where none waits.
CONCEPT, SOUND, FORCED = "A {} was just detected. Describe what's happening with it.", "An audio event '{}' was detected. What's happening?", "Describe what's happening in this frame."


class Gate:
    """One timeline's step, for streams: its cooldown, the question that waits, and the times of its context."""

    def __init__(self, seconds: float = 1.0, window: float = 300.0, most: int = 2048):
        self.cool, self.window, self.most = stateful.Cooldown(seconds), window, most
        self.question: str | None = None
        self.times: deque[float] = deque()
        self.answered: float | None = None

    @staticmethod
    def rank(kind: str) -> int:
        return KINDS.index(kind) if kind in KINDS else len(KINDS)

    def step(self, t: float, seq: int, kind: str, label: str | None):
        if kind == "context":
            self.times.append(t)
            while self.times[0] < t - self.window or len(self.times) > self.most:
                self.times.popleft()
        elif kind == "question":
            self.question = label
        elif (kind in ("visual", "audio") and self.cool.step(t)) or (kind == "force" and self.answered != t):
            own = FORCED if kind == "force" else CONCEPT.format("object" if label is None else label) if kind == "visual" else SOUND.format("sound" if label is None else label)
            asked, self.question, self.answered = self.question or own, None, t
            return t, seq, kind, label, asked, len(self.times), self.times[-1] - self.times[0] if self.times else None
        return None

    def state(self) -> dict:
        return {"last": self.cool.last, "question": self.question, "times": list(self.times), "answered": self.answered}

    def restore(self, state: dict) -> Gate:
        self.cool.last, self.question, self.times, self.answered = state["last"], state["question"], deque(state["times"]), state["answered"]
        return self


def own_question(kind: Column, label: Column) -> Column:
    concept = records.trigger_query(F.when(kind == "visual", "concept").otherwise(kind), label, label)
    return F.when(kind == "force", FORCED).otherwise(concept)


def asked(rows: DataFrame, seconds: float = 1.0, window: float = 300.0, most: int = 2048, pieces: int = ordered.ROWS) -> DataFrame:
    """(timeline_id, t_sec, seq, kind, label, question, n_context, span) of every answered moment.

    Candidates pass the cooldown; a forced moment is answered unless its time has been. The question is the last one that waits (an empty one does not), each going to the first answer at or after it; else one made of what fired. ``n_context`` and ``span`` are those of the context after its last row so far. Each of these is a join along time that cuts hot timelines; rows of other kinds are ignored.
    """
    of = lambda kind: rows.where(F.col("kind") == kind)
    keys = ["timeline_id", "t_sec"]
    fired = stateful.triggers(rows.where(F.col("kind").isin("visual", "audio")).withColumn("source", F.col("kind")), seconds, pieces).withColumnRenamed("source", "kind")
    forced = of("force").groupBy(*keys).agg(F.min("seq").alias("seq")).withColumn("kind", F.lit("force")).join(fired.select(*keys).distinct(), keys, "left_anti")
    labels = rows.select(*keys, "seq", "kind", "label")
    answers = fired.unionByName(forced).join(labels, [*keys, "seq", "kind"])
    questions = of("question").select(*keys, "seq", "label")
    to = ordered.nearest(questions, answers.select(*keys, "seq").distinct(), "timeline_id", "t_sec", "t_sec", "seq", "forward", pieces).where("state is not null")
    waiting = to.groupBy("timeline_id", F.col("state.t_sec").alias("t_sec"), F.col("state.seq").alias("seq")).agg(F.max_by(F.struct("label"), F.struct(F.col("t_sec"), F.col("seq"))).alias("q"))
    context = TL.context_sizes(of("context").select(*keys, "seq"), window, most, pieces).withColumn("late", -F.col("seq"))
    with_context = ordered.nearest(answers, context, "timeline_id", "t_sec", "t_sec", "late", "backward", pieces)
    out = with_context.join(waiting, [*keys, "seq"], "left")
    left = F.col("q.label")
    question = F.when(F.length(left) > 0, left).otherwise(own_question(F.col("kind"), F.col("label")))
    return out.select(*keys, "seq", "kind", "label", question.alias("question"), F.coalesce("state.n_context", F.lit(0)).cast("bigint").alias("n_context"), F.col("state.span").alias("span"))


def answered(moments: DataFrame, model: Callable, schema: str) -> DataFrame:
    """What ``model``, a function of pandas frames, makes of the asked moments, in batch or over a stream; it sees no other row."""
    return moments.mapInPandas(lambda frames: map(model, frames), schema)
