"""The one exception of the graph engine."""

KINDS = (
    "ContradictoryPaths", "DuplicateEdge", "InvalidArgument", "LaPackError", "NodeNotFound", "NoPartitions", "NotAPartition", "EdgeNotFound",
    "EdgeWeightNotSpecified", "PowerIterationFailedConvergence", "ReadError", "SelfLoopsFound", "WrongMethod",
)


class GraphError(Exception):
    def __init__(self, kind: str, message: str):
        assert kind in KINDS
        super().__init__(f"{kind}: {message}")
        self.kind, self.message = kind, message
