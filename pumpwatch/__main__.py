import sys

from pumpwatch.cli import main

sys.exit(main())
