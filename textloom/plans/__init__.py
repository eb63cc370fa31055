"""Grammar compilation on the driver: expressions to automata to tables that kernels run."""
