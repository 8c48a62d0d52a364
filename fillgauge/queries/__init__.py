"""The registered queries: each operator run over whole tables, with its SQL twin."""

from fillgauge.queries import (aggregates, columns, evaluation, gaps, masking, modelling,  # noqa: F401
                               storage)
from fillgauge.queries.base import ORACLES, QUERIES  # noqa: F401
