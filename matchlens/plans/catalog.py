"""All registered queries."""
from matchlens.plans.registry import QUERIES  # noqa: F401
from matchlens.plans import q_windows  # noqa: F401
from matchlens.plans import q_events  # noqa: F401
from matchlens.plans import q_grading, q_grid  # noqa: F401
from matchlens.plans import q_joins, q_measure  # noqa: F401
from matchlens.plans import q_report  # noqa: F401
from matchlens.plans import q_episode  # noqa: F401
from matchlens.plans import q_select  # noqa: F401
from matchlens.plans import q_quality  # noqa: F401
from matchlens.plans import q_sources  # noqa: F401
