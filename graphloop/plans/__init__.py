"""Fixpoint plans: columnar supersteps, imperative vertex programs, map-reduce-update, pipelines."""
