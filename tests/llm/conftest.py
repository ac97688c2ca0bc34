from tests.conftest import folder, spark  # noqa: F401
