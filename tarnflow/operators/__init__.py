"""tarnflow.operators"""
