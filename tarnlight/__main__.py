import sys

from tarnlight.cli import main

sys.exit(main())
