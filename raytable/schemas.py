"""Strict table schemas. Each field: name -> (Spark type, default or REQUIRED)."""

from __future__ import annotations

REQUIRED = object()

MATCHES = {"record_id": ("string", REQUIRED), "moving_view": ("string", REQUIRED), "reference_view": ("string", REQUIRED),
           "moving_feature": ("bigint", None), "reference_feature": ("bigint", None), "metric": ("double", None),
           "moving_row": ("double", None), "moving_col": ("double", None), "reference_row": ("double", None), "reference_col": ("double", None),
           "state": ("string", "accepted"), "source_uncertainty": ("double", 1.0)}

VIEWS = {"view_id": ("string", REQUIRED), "pass_id": ("string", "pass-default"), "position": ("bigint", None), "pixel_count": ("bigint", None),
         "x0": ("double", None), "x1": ("double", None), "y0": ("double", None), "y1": ("double", None)}

POINTS = {"point_id": ("string", REQUIRED), "x": ("double", None), "y": ("double", None), "z": ("double", None), "mode_id": ("string", ""),
          "pass_id": ("string", "pass-default"), "view_id": ("string", None), "pass_count": ("bigint", 1), "sigma": ("double", None)}
