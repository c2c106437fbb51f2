"""python -m mirrorframe"""

import sys

from mirrorframe.cli import main

sys.exit(main())
