"""Reading and writing tables and small artefacts."""
