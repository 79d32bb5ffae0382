"""corelev: importance-score data reduction and p-generalised probit analytics on Spark."""

from .session import get_session  # noqa: F401
from .sources.design import Design, DesignSpec, build_design  # noqa: F401

__version__ = "0.1.0"
