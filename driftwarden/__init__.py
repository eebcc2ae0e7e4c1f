"""Drift-aware loading on Spark: compare, heal, quarantine and record batches of changing shape."""

from driftwarden.options import Options
from driftwarden.plans.load import Load
from driftwarden.plans.replay import replay
from driftwarden.plans.run import run
from driftwarden.plans.state import State
from driftwarden.sources.pieces import Piece, tag

__all__ = ["Load", "Options", "Piece", "State", "replay", "run", "tag"]
