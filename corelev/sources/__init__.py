"""Design tables, file sources and result sinks."""

from .design import Design, DesignSpec, build_design, from_arrays, validate_design  # noqa: F401
