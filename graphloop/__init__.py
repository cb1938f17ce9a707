"""Iterative analytics as DataFrame programs: bulk-synchronous graph computation and map-reduce-update learning."""

from graphloop.graph import Graph
from graphloop.plans.superstep import Plan, VertexProgram, run_program

__all__ = ["Graph", "Plan", "VertexProgram", "run_program"]
