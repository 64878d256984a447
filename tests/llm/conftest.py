"""The session of the library's tests, with the repository on the workers' path."""

import os
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
