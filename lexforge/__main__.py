import sys

from lexforge.cli import main

sys.exit(main())
