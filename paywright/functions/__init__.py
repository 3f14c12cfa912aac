"""Column-level building blocks: everything here returns ``Column`` expressions or plain DataFrame plans."""
