"""A session's events in a trigger are handled as plain values, not as small frames."""

from types import SimpleNamespace

import pandas as pd

from graphloom.streaming import store as T


class Kept(dict):
    """A value or map of state, in memory."""

    def get(self):
        return super().get("value")

    def exists(self):
        return "value" in self

    def update(self, value):
        self["value"] = value

    def updateValue(self, key, value):
        self[key] = value


def test_no_frames_are_sorted_or_selected(monkeypatch):
    state = T.SessionState()
    state.init(SimpleNamespace(getValueState=lambda *_: Kept(), getMapState=lambda *_: Kept()))
    row = lambda at, i, op, part, a=None, v=None, **more: {"session_id": "s", **dict.fromkeys(T.PARTS), "event_id": at, "i": i, "op": op, "with_nodes": op == "update", "with_edges": False, "with_progress": False, "part": part, "a": a, "v": v, **more}
    frames = [pd.DataFrame([row(3, 1, "update", "node", "y", "current"), row(3, 0, "update", "event")]), pd.DataFrame([row(1, 0, "update", "event"), row(1, 1, "update", "node", "x", None), row(2, 0, "clear", "event")])]
    for name in ("sort_values", "drop_duplicates", "to_dict", "itertuples"):
        monkeypatch.setattr(pd.DataFrame, name, None)
    (out,) = list(state.handleInputRows(("s",), iter(frames), None))
    assert out["event_id"].tolist() == [1, 2, 3] and out["revision"].tolist() == [1, 2, 3]
    assert dict(state.nodes) == {("y",): ("current",)}
