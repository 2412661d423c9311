from __future__ import annotations

import json

from maskwork.streaming import conversations

TURNS = [(1, 0, "user", "I am a@b.cd"), (1, 1, "assistant", "Hello a@b.cd or c@d.ef"), (2, 0, "user", "c@d.ef"), (1, 2, "user", "c@d.ef again, new x@y.zz"), (2, 1, "user", None)]
WANT = {(1, 0): "I am [EMAIL_1]", (1, 1): "Hello [EMAIL_1] or [EMAIL_2]", (1, 2): "[EMAIL_2] again, new [EMAIL_3]", (2, 0): "[EMAIL_1]", (2, 1): ""}


def test_table(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.turn): r.text for r in conversations.anonymize_table(df, regions=[]).collect()} == WANT


def test_stream_keeps_numbers_over_batches(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    src = tmp_path / "in"
    src.mkdir()
    out = conversations.anonymize_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)), regions=[])
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    for k, part in enumerate((TURNS[:3], TURNS[3:])):
        (src / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("conv_id", "turn", "role", "text"), t))) for t in part))
        q.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.conv_id, r.turn): r.text for r in got} == WANT
    added = {(r.conv_id, r.turn): json.loads(r.mappings) for r in got}
    assert [m["placeholder"] for m in added[1, 2]] == ["[EMAIL_3]"]


class State:
    """What a key's state offers to the function over it."""

    def __init__(self, value=None, timed_out=False):
        self.value, self.hasTimedOut, self.duration, self.removed = value, timed_out, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value, self.removed = None, True

    def setTimeoutDuration(self, ms):
        self.duration = ms


def test_idle_conversations_are_forgotten():
    import pandas as pd

    span = {"type": "EMAIL", "value": None, "start": 0, "end": 6, "confidence": 0.9, "detector": "x", "source": "rule", "enabled": True}
    turn = lambda k, text: pd.DataFrame([(1, k, "user", text, [span])], columns=["conv_id", "turn", "role", "text", "spans"])
    run = lambda state, *frames: [r.text for f in conversations._with_state((1,), frames, state, 5000) for r in f.itertuples()]
    state = State()
    assert run(state, turn(0, "a@b.cd")) == ["[EMAIL_1]"] and state.duration == 5000
    assert run(State(state.value), turn(1, "x@y.zz")) == ["[EMAIL_2]"]
    idle = State(state.value, timed_out=True)
    assert run(idle) == [] and idle.removed
    assert run(State(idle.value), turn(2, "x@y.zz")) == ["[EMAIL_1]"]
