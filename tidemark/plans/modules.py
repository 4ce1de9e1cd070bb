"""Imports every module that registers queries."""

from tidemark.plans import q_bars, q_conformal, q_info, q_labels, q_micro, q_more, q_pit, q_portfolio, q_research, q_stream  # noqa: F401
