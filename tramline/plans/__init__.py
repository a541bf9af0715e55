"""Registered queries: operators applied to views of the driver's tables, each beside DuckDB SQL for the same rows."""

from tramline.plans import areas, evaluation, extra, files, fitting, lines, money, more, speeds, timetable, whole  # noqa: F401  they register their queries
from tramline.plans.registry import QUERIES, SQL  # noqa: F401
