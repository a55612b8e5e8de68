"""Import every check module so that the registry is complete."""

from tablesmith.registry import QUERIES, ORACLES  # noqa: F401
from tablesmith.registry import profile_q  # noqa: F401
from tablesmith.registry import prep_q  # noqa: F401,E402
from tablesmith.registry import eval_q, select_q  # noqa: F401,E402
from tablesmith.registry import model_q  # noqa: F401,E402
from tablesmith.registry import io_q  # noqa: F401,E402
