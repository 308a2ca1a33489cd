"""Operators for preparing training corpora; see ``spindrift.llm.queries``."""
