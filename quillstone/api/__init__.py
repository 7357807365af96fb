"""The user's way in: one table of sealed state with lookup, store and retrieve."""

from quillstone.api.frame import ENGINE_VERBS, EngineView, StateFrame

__all__ = ["ENGINE_VERBS", "EngineView", "StateFrame"]
