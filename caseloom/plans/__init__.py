"""Registered queries, one module per area."""

import importlib

MODULES = ["core", "audit", "splits", "encoding", "models", "evaluation", "downstream", "traces", "learners", "streams"]


def load_all():
    for m in MODULES:
        importlib.import_module(f"caseloom.plans.{m}")
    return importlib.import_module("caseloom.plans.registry")
