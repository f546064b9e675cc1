import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path
