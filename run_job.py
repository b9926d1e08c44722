"""Entry script for spark-submit."""

from ledgertally.jobs import main

if __name__ == "__main__":
    main()
