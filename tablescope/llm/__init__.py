"""Training-data operators: filtering, deduplication, decontamination, extraction and
tokenization of large text corpora. Nothing else in the library imports this package.

Tasks run functions of this package. Python workers import it where it is installed, on
their PYTHONPATH or in the folder they start in; where none of these holds (a driver that
only extended its own sys.path) its functions travel with the job instead.
"""

import os
import site
import sys


def _workers_can_import() -> bool:
    root = os.path.realpath(os.path.join(os.path.dirname(__file__), "..", ".."))
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages(), site.getusersitepackages()]
    return root in {os.path.realpath(p) for p in found if p}


if not _workers_can_import():
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
