"""Values that the SQL of the queries takes from the code, written out."""

from graphloom import schema
from graphloom.functions.expressions import BUILTINS
from graphloom.operators.metrics import KIND_WEIGHTS


def test_weights_and_kinds():
    assert KIND_WEIGHTS == {"Module": 1.0, "Class": 0.9, "Interface": 0.9, "Function": 0.7, "Method": 0.7, "Enum": 0.6, "Variable": 0.3, "Field": 0.3, "Import": 0.1, "File": 0.1}
    assert schema.FUNCTION_KINDS == ("Function", "Method") and schema.MODULE_KINDS == ("Class", "Interface", "Module")
    assert sorted(schema.CONTAINER_KINDS) == ["Class", "Enum", "File", "Interface", "Module"]
    assert sorted(schema.DEFINITION_KINDS) == ["Class", "Enum", "Field", "Function", "Interface", "Method", "TypeAlias", "Variable"]
    assert len(schema.NODE_KINDS) == 14 and (schema.LIST_LIMIT, schema.SEARCH_LIMIT) == (50_000, 50)


def test_builtins():
    assert len(set(BUILTINS)) == len(BUILTINS) == 69 and {"println", "print", "len"} <= set(BUILTINS)
