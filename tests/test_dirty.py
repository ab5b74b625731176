"""Every query of the core over empty and awkward tables: none may fail."""

import pytest
from dirty import make
from test_queries import CORE

# These take a row of a table as their parameter, so they need one.
NEED_A_ROW = {"cosine_all", "cosine_rerank"}


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return make(tmp_path_factory.mktemp("empty"), "empty")


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    return make(tmp_path_factory.mktemp("awkward"), "awkward")


@pytest.mark.parametrize("name", sorted(set(CORE) - NEED_A_ROW))
def test_empty(spark, empty, name):
    CORE[name][0](spark, empty).count()


@pytest.mark.parametrize("name", sorted(CORE))
def test_awkward(spark, awkward, name):
    CORE[name][0](spark, awkward).collect()
