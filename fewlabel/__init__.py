"""Label-efficient inference over large text tables, expressed as Spark jobs."""
