"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from nightframe.plans import event_layer, inference_layer, nightly, source_layer, wearable_layer

LAYERS = (nightly, event_layer, inference_layer, wearable_layer, source_layer)

QUERIES = {name: f for layer in LAYERS for name, f in layer.QUERIES.items()}
ORACLES = {name: sql for layer in LAYERS for name, sql in layer.ORACLES.items()}
