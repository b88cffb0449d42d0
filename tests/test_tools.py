"""Every registered tool runs on the smallest tables, by its own schema."""

import pytest

from candela.plans import registry, tools  # noqa: F401

SF = "/root/testdata/sf0.001"
GIVEN = {"symbol": "A", "ticker": "src0", "name": "1"}


@pytest.mark.parametrize("name", registry.names())
def test_tool(spark, name):
    needed = next(x for x in registry.schemas() if x["name"] == name)["parameters"]["required"]
    frame = registry.call(spark, SF, name, {k: GIVEN[k] for k in needed})
    assert frame.columns and len(frame.limit(3).collect()) <= 3


def test_arguments_are_checked(spark):
    with pytest.raises(KeyError):
        registry.call(spark, SF, "no_such_tool")
    with pytest.raises(ValueError):
        registry.call(spark, SF, "rsi", {})
    with pytest.raises(ValueError):
        registry.call(spark, SF, "rsi", {"symbol": "A", "colour": "red"})
